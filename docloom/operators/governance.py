"""Access by role, audit records and request limits over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.providers import FixedWindow, RateLimiter


def with_role(actions: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """The actions of actors that hold the role; roles(actor, role)."""
    return actions.join(roles.filter(F.col("role") == role).select("actor"), "actor", "left_semi")


def audit(events: DataFrame, actor: str, action: str, resource: str, ts: str) -> DataFrame:
    """(actor, action, resource, timestamp_unix), to be appended to a table."""
    return events.select(F.col(actor).cast("string").alias("actor"), F.col(action).alias("action"), F.col(resource).cast("string").alias("resource"), F.unix_timestamp(ts).alias("timestamp_unix"))


def limited(requests: DataFrame, limiter: RateLimiter, actor: str, ts: str, order: str) -> DataFrame:
    """requests with allowed, by any limiter."""
    return requests.withColumn("allowed", limiter.allowed(actor, ts, order))


def rate_limit(requests: DataFrame, actor: str, ts: str, order: str, window_seconds: int, most: int) -> DataFrame:
    """requests with window_start and allowed: the first `most` of an actor in each window since the epoch."""
    second = F.unix_timestamp(ts)
    start = second - F.pmod(second, F.lit(window_seconds))
    return limited(requests.withColumn("window_start", start), FixedWindow(window_seconds, most), actor, ts, order)
