"""Progress events of documents as rows, and request limits over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import word_count
from docloom.operators.reduce import reduced_levels
from docloom.operators.textrank import Options
from docloom.sources.parse import full_text, read_documents

#: What an event tells, beside its phase; null where the phase doesn't tell it.
PAYLOAD = "total_bytes long, format string, sections long, words long, sentences long, key_points long, reduced_json string, message string"
RESULT = "title string, source_format string, summary string, key_points array<string>, keywords array<string>, metrics struct<original_words:long,reduced_words:long,retention_ratio:double,reduction_percent:double,original_sentences:long,key_points:long,keywords:long>"


def progress_events(docs: DataFrame, options: Options = Options(), hint: str | None = None) -> DataFrame:
    """(doc_id, seq, phase, and what PAYLOAD names) of docs(doc_id, content): started (total_bytes), detected (format),
    parsed (sections, words), summarized (sentences, key_points) and done (reduced_json); or started, detected and error
    (message). One map without a shuffle, so it works on streams, too."""
    d = read_documents(docs, hint=hint).select("doc_id", "format", "doc", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"))
    d = d.withColumn("words", word_count(full_text(F.col("doc")))).withColumn("r", F.get(reduced_levels(full_text(F.col("doc"), ("code",)), [options]), F.lit(0)))
    short = word_count(F.col("r.compressed"))
    original = F.col("r.original_words")
    ratio = F.when(original > 0, short / original).otherwise(0.0)
    measured = F.struct(
        original.alias("original_words"), short.alias("reduced_words"), ratio.alias("retention_ratio"), F.when(original > 0, (1 - ratio) * 100).otherwise(0.0).alias("reduction_percent"),
        F.col("r.original_sentences").alias("original_sentences"), F.size("r.key_points").alias("key_points"), F.size("r.keywords").alias("keywords"),
    )
    result = F.to_json(F.struct(F.coalesce("doc.title", "r.title").alias("title"), F.col("format").alias("source_format"), F.col("r.compressed").alias("summary"), "r.key_points", "r.keywords", measured.alias("metrics")))
    types = dict(x.split() for x in PAYLOAD.split(", "))

    def event(phase: str, **told: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), *(told.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))

    begun = [event("started", total_bytes=F.col("size")), event("detected", format=F.col("format"))]
    good = [event("parsed", sections=F.size("doc.sections"), words=F.col("words")), event("summarized", sentences=F.col("r.original_sentences"), key_points=F.size("r.key_points")), event("done", reduced_json=result)]
    steps = F.when(F.col("doc.error").isNull(), F.array(*begun, *good)).otherwise(F.array(*begun, event("error", message=F.col("doc.error"))))
    return d.select("doc_id", F.posexplode(steps).alias("seq", "e")).select("doc_id", F.col("seq").cast("long").alias("seq"), "e.*")


def last_result(events: DataFrame) -> DataFrame:
    """(doc_id, result, error): the reduced document that a document's events end with, or the reason why there is none."""
    ended = events.filter("phase in ('done', 'error')")
    return ended.select("doc_id", F.from_json("reduced_json", RESULT).alias("result"), F.col("message").alias("error"))


def rate_limit_stream(requests: DataFrame, window_seconds: int, most: int) -> DataFrame:
    """(actor, request_id, allowed) of a stream requests(actor, request_id, ts): the first `most` of each actor and window.

    State is one count for each actor and open window; it goes when the watermark passes the window's end.
    """

    def check(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "request_id"])
            turn = range(count + 1, count + len(pdf) + 1)
            count += len(pdf)
            yield pd.DataFrame({"actor": pdf["actor"], "request_id": pdf["request_id"], "allowed": [t <= most for t in turn]})
        state.update((count,))
        end = (int(key[1]) + window_seconds) * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    second = F.unix_timestamp("ts")
    keyed = requests.withWatermark("ts", "10 minutes").withColumn("window_start", second - F.pmod(second, F.lit(window_seconds)))
    return keyed.groupBy("actor", "window_start").applyInPandasWithState(check, "actor string, request_id long, allowed boolean", "n long", "append", "EventTimeTimeout")
