"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares p of the sources are raised to an exponent a and normalised. a is the largest in [0, 1] at which the entropy
of the weights reaches a target; where that would repeat a source more often than allowed, a is the smallest that keeps
the limit. Both are found by bisection: entropy and repetitions fall as a grows. Each round evaluates a grid of exponents
in one aggregation over the table of sources, which halves the interval several times at once.

The weights are then realised as a budget of tokens for each source. A source's documents lie in blocks by hash, each
epoch visits the blocks in a permutation of its own, whole epochs take every block, and the last, partial one takes blocks
in its order while they fit; of the block at the edge it takes documents in hash order while they fit. Blocks are summed in
order at two levels: ranges of the order first, then the blocks of the range at the edge. So all that is summed in order
by one task are RANGES sums, the blocks of one range, or the documents with tokens of one block of a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.llm.tables import scratch, written

GRID = 32
#: Ranges of a source's block order, a power of two.
RANGES = 4096
#: Sources are sent to every task up to this number of them (under 10 MB); beyond it they are joined by shuffle.
MOST_BROADCAST = 50_000
SALTS = 64


@dataclass(frozen=True)
class Mix:
    """entropy: the target, as a share of the logarithm of the number of sources. repeats: most epochs over a source.

    budget: tokens to take; None takes the whole corpus's number of tokens, "cover" the least budget that takes every
    document at least once.
    """

    entropy: float = 0.97
    repeats: float = 4.0
    budget: int | str | None = None
    block_tokens: int = 1 << 18
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A text for each source; null is a source of its own."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _hashed(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _exponent(shares: DataFrame, entropy: float, repeats: float, budget_ratio: float | None) -> float:
    """shares: column x, ln(p / largest p) of each source with tokens. budget_ratio: budget over all tokens; None: cover."""
    base = shares.agg(F.count("*"), F.min("x"), F.sum(F.exp("x"))).first()
    n, least, _ = base
    if not n or least == 0.0:
        return 1.0
    target = entropy * math.log(n)
    largest = 1.0 / base[2]  # the largest share

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, epochs of the smallest source) of each exponent."""
        row = shares.agg(*(f(F.exp(a * F.col("x")) * w) for a in exponents for f, w in ((F.sum, F.lit(1.0)), (F.sum, F.col("x"))))).first()
        out = []
        for i, a in enumerate(exponents):
            z, s = row[2 * i], row[2 * i + 1]
            # epochs of a source = budget * weight / tokens; with cover, the least of them, at the largest source, is one
            epochs = math.exp((a - 1) * least) * (1.0 if budget_ratio is None else budget_ratio / (z * largest))
            out.append((math.log(z) - a * s / z, epochs))
        return out

    def bisect(holds, low: float, high: float) -> tuple[float, float]:
        """The ends of an interval in which holds turns from true to false."""
        while high - low > 1e-12:
            grid = [low + (high - low) * (i + 1) / (GRID + 1) for i in range(GRID)]
            if not low < grid[0] < grid[-1] < high:
                break
            first = next((i for i, v in enumerate(at(grid)) if not holds(v)), GRID)
            low, high = (grid[first - 1] if first else low), (grid[first] if first < GRID else high)
        return low, high

    (top, epochs_1), (flat, epochs_0) = at([1.0, 0.0])
    if top >= target:
        a, epochs = 1.0, epochs_1
    elif flat < target:
        a, epochs = 0.0, epochs_0
    else:
        a = bisect(lambda v: v[0] >= target, 0.0, 1.0)[0]
        epochs = at([a])[0][1]
    if epochs > repeats:
        a = 1.0 if epochs_1 > repeats else bisect(lambda v: v[1] > repeats, a, 1.0)[1]
    return a


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns and mix_epoch (from 1), mix_block, mix_order.

    Training order is by mix_epoch, mix_order (the block's place in the permutation of its source's blocks in that epoch),
    mix_block and doc_id. Tokens are words. A null source is a source of its own; a null text has no tokens. Rows of
    a source without tokens are taken once. Rows that are equal in doc_id and source are taken or left together. An empty
    table gives an empty one. Columns of docs with the names of the three new ones are replaced.
    """
    with scratch():
        return _mixed(docs, mix)


def _mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key, spot = _key(F.col("source")), _hashed(F.lit(str(mix.seed)), id_text)
    thin = written(docs.select(key.alias("k"), spot.alias("h"), word_count(F.col("text")).alias("tokens")), "mix-rows")
    totals = written(thin.groupBy("k").agg(F.sum("tokens").alias("t")), "mix-sources")
    n_sources, total, largest = totals.agg(F.count("*"), F.sum("t"), F.max("t")).first()
    if not total:
        total = largest = 0
    shares = totals.filter("t > 0").select(F.log(F.col("t") / F.lit(float(largest or 1))).alias("x"))
    ratio = None if mix.budget == "cover" else (1.0 if mix.budget is None else float(mix.budget) / max(1, total))
    a = _exponent(shares, mix.entropy, mix.repeats, ratio)
    z = shares.agg(F.sum(F.exp(a * F.col("x")))).first()[0] or 1.0
    # with cover, the largest source, of weight 1 / z, is taken once
    budget = float(largest) * z if ratio is None else ratio * total
    x = F.log(F.col("t") / F.lit(float(largest or 1)))
    goal = F.when(F.col("t") > 0, F.floor(F.lit(budget) * F.exp(F.lit(a) * x) / F.lit(z) + F.lit(1e-6))).otherwise(0)
    if ratio is None:
        goal = F.greatest(goal, F.col("t"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(float(mix.block_tokens)))).cast("long")
    sources = totals.select("k", "t", blocks.alias("n_blocks"), goal.cast("long").alias("goal")).select(
        "k", "n_blocks",
        F.when(F.col("t") > 0, F.floor(F.col("goal") / F.greatest(F.col("t"), F.lit(1)))).otherwise(1).cast("long").alias("whole"),
        F.when(F.col("t") > 0, F.col("goal") % F.greatest(F.col("t"), F.lit(1))).otherwise(0).cast("long").alias("rest"),
    )

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        """rows with the columns of table, by k; a hot source's rows are dealt over many keys."""
        if n_sources <= MOST_BROADCAST:
            return rows.join(F.broadcast(table), "k")
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["k", "salt"]).drop("salt")

    block = F.pmod("h", "n_blocks")

    def order(epoch: Column) -> Column:
        return _hashed(F.lit(f"{mix.seed}/block"), F.col("k"), F.col("b").cast("string"), epoch.cast("string"))

    sized = with_source(thin, sources).select("k", "h", "tokens", "whole", "rest", block.alias("b"))
    dealt = sized.filter("rest > 0").groupBy("k", "b", "whole", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("o", order(F.col("whole") + 1))
    dealt = written(dealt.withColumn("range", F.shiftright("o", 60 - RANGES.bit_length() + 1)), "mix-blocks")

    def first_beyond(sums: DataFrame, by: list[str]) -> DataFrame:
        """Of each source, the first row, ordered by `by`, up to which more than rest is summed, and what is left for it (room)."""
        taken = Window.partitionBy("k").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        beyond = sums.withColumn("sum", F.sum("tokens").over(taken)).filter("sum > rest")
        return beyond.groupBy("k").agg(F.min(F.struct(*by, (F.col("rest") - F.col("sum") + F.col("tokens")).alias("room"))).alias("e")).select("k", "e.*")

    ranges = written(first_beyond(dealt.groupBy("k", "rest", "range").agg(F.sum("tokens").alias("tokens")), ["range"]), "mix-ranges")
    within_range = dealt.select("k", "b", "o", "range", "tokens").join(ranges.withColumnRenamed("room", "rest"), ["k", "range"])
    edge = written(first_beyond(within_range, ["o", "b"]), "mix-edges")
    at_edge = with_source(thin.filter("tokens > 0"), sources.join(edge, "k").select("k", "n_blocks", F.col("b").alias("edge_b"), "room")).filter(block == F.col("edge_b"))
    by_hash = at_edge.groupBy("k", "h", "room").agg(F.sum("tokens").alias("tokens"))  # rows of one id stay together
    within = Window.partitionBy("k").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    limits = by_hash.withColumn("sum", F.sum("tokens").over(within)).filter("sum <= room").groupBy("k").agg(F.max("h").alias("last_h"))
    table = written(
        sources.join(edge.withColumnRenamed("b", "edge_b").withColumnRenamed("o", "edge_o"), "k", "left").join(limits, "k", "left").drop("rest", "room"), "mix-plan", keep=True
    )
    made = ("mix_epoch", "mix_block", "mix_order")
    names = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("k"), spot.alias("h"))
    placed = with_source(rows, table).withColumn("b", block)
    last = F.col("whole") + 1
    o = order(last)
    partly = F.col("edge_o").isNotNull() & ((F.struct(o, F.col("b")) < F.struct("edge_o", "edge_b")) | ((F.col("b") == F.col("edge_b")) & (F.col("h") <= F.coalesce("last_h", F.lit(-1)))))
    copies = (F.col("whole") + F.when(partly, 1).otherwise(0)).cast("int")
    return (
        placed.filter(copies > 0)
        .select("row", "k", "b", F.explode(F.sequence(F.lit(1), copies)).alias("mix_epoch"))
        .select(*[F.col(f"row.`{c}`") for c in names], "mix_epoch", F.col("b").alias("mix_block"), order(F.col("mix_epoch")).alias("mix_order"))
    )
