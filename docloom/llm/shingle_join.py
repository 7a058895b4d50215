"""Exact n-gram Jaccard join of documents by grouped prefixes.

Each document is the set of hashes of its word shingles. Sets are ordered by hash; a set's head is its part below a fixed
share of the hash range (all of a small set). Documents with the same head and size are one group, so copies collapse
before anything is joined.

1. Heads are dealt to buckets by token, as packed arrays, each group once from each task. A token that more than MOST
   groups have is common; a task that finds it common by itself sends one mark instead of its groups. Groups that share a
   token that isn't common become a pair, with the number of such tokens they share.
2. In the order "tokens that aren't common by hash, then common ones", a set of n tokens has a prefix of
   n - ceil(0.75 n) + 1 tokens, and linked sets share a token of the prefix of each. So a group with at least as many
   tokens that aren't common in its head meets all that it links with; the number of shared tokens and the sizes then
   rule out nearly all pairs that don't link, without any set at hand. The other groups, made up of common tokens, are
   joined among each other once more over their whole sets, ordered from rare to common.
3. Of each pair of groups one pair of sets is verified: first one pair for each set, then only pairs whose sets aren't
   connected yet. Where a group has several sets, its members are expanded into lists: the sets of one group, those of two
   groups that meet and aren't connected as a whole yet, and those that have a common token. A list never becomes pairs: it
   is a grid of blocks of bounded bytes, whose sets are compared by a matrix product of their shared tokens, and what
   leaves a block is a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.components import components
from docloom.llm.tables import by_batch, give_back, scratch, written

WORDS = 5
#: Links hold at 100 * shared >= 75 * united; a prefix is a quarter of the set and one token.
MOST = 40
SMALL = 64
HEAD = np.uint64(1 << 63)  # half of the hash range
BUCKET_TOKENS = 250_000
FLUSH_TOKENS = 400_000
#: Sets and bytes of one block of a list, about, and bytes of the blocks that are compared in one call.
LIST_BLOCK, BLOCK_BYTES, CALL_BYTES = 1024, 6_000_000, 12_000_000
#: Ids of documents whose sets are read again are sent to all tasks up to this number (about 20 MB); beyond it they are joined.
MOST_BROADCAST = 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POSITIONS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, WORDS + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = _powers(_ODD, 1 << 10)
    down = _powers(_INVERSE, 1 << 10)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = _powers(_ODD, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased data, and the bytes at which they begin."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _Powers.of(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _set_of(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        h = np.uint64(n)
        for w, k in zip(words, _POSITIONS, strict=False):
            h = h + w * k
        return _mixed(np.array([h]))
    h = np.full(n - WORDS + 1, np.uint64(WORDS))
    for i, k in enumerate(_POSITIONS):
        h = h + words[i : n - WORDS + 1 + i] * k
    return np.unique(_mixed(h))


def shingle_sets(texts: list[str | None], group: int = 1 << 18) -> Iterator[np.ndarray]:
    """The set of each text, worked out in groups of about 256 kB; longer texts are cut at spaces."""
    np.seterr(over="ignore")
    waiting: list[bytes] = []

    def ready() -> Iterator[np.ndarray]:
        words, starts = word_hashes(b"\n".join(waiting))
        cuts = np.cumsum([0, *(len(w) + 1 for w in waiting)])
        at = np.searchsorted(starts, cuts)
        for i in range(len(waiting)):
            yield _set_of(words[at[i] : at[i + 1]])
        waiting.clear()

    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if size + len(data) > group and waiting:
            yield from ready()
            size = 0
        if len(data) > 4 * group:
            parts, a = [], 0
            while a < len(data):
                b = a + group
                while b < len(data) and not _SPACE[data[b]]:
                    b += 1
                parts.append(word_hashes(data[a:b])[0])
                a = b
            yield _set_of(np.concatenate(parts))
            continue
        waiting.append(data)
        size += len(data)
    if waiting:
        yield from ready()


def _folded(x: np.ndarray, salt: int) -> int:
    """A hash of a sorted set, as a signed long."""
    if not len(x):
        return 0
    h = int(np.bitwise_xor.reduce(_mixed(x + np.uint64(salt)))) ^ int(np.add.reduce(_mixed(x * np.uint64(_ODD) + np.uint64(salt)))) ^ len(x)
    h = (h * _ODD) & ((1 << 64) - 1)
    return h - (1 << 64) if h >= 1 << 63 else h


def head_of(x: np.ndarray) -> np.ndarray:
    return x if len(x) <= SMALL else x[: np.searchsorted(x, HEAD)]


def _group(x: np.ndarray) -> int:
    h = head_of(x)
    return _folded(np.append(h, np.uint64(len(x))), 5) if len(x) else 0


def thin_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of its set), h1 and h2 (of the set), g (of its group), low and head (tokens below HEAD, and in the head)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (s.as_py() for s in batch.column("text"))
        rows = [(len(x), _folded(x, 1), _folded(x, 2), _group(x), int(np.searchsorted(x, HEAD)), len(head_of(x))) for x in shingle_sets(texts)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "h1", "h2", "g", "low", "head"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, h1 long, h2 long, g long, low long, head long")


#: What a bucket's rows hold: packed tokens and groups, or tokens that a task found common.
_ENTRY = np.dtype([("token", "<u4"), ("g", "<i8")])


def _common(token: np.ndarray, low: np.ndarray, g: np.ndarray) -> pd.DataFrame:
    """(a, b, m, x, y): m = 0, a = b = g, x common tokens of g in its head, y of them below HEAD."""
    at = pd.DataFrame({"a": g, "x": 1, "y": low.astype(np.int64)}).groupby("a", sort=False).sum().reset_index()
    return pd.DataFrame({"a": at["a"], "b": at["a"], "m": 0, "x": at["x"], "y": at["y"]})


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data, a, x, y): packed entries of a bucket; or, with bucket -1, common tokens of group a.

    Of a token, the upper part of its hash's lower 63 bits names the bucket and the next 32 bits stand for it; the top
    bit, whether it is below HEAD, goes with it. Tokens that happen to be the same in this bring a pair more, not less.
    """
    schema = "bucket int, data binary, a long, x long, y long"

    def packed(sets: list[np.ndarray], groups: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(sets)
        g = np.repeat(np.array(groups, np.int64), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, g = tokens[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        common = np.repeat(counts > MOST, counts)
        told = _common(tokens[common], tokens[common] < HEAD, g[common])
        marks = tokens[first[counts > MOST]]
        tokens = np.concatenate([tokens[~common], marks])
        g = np.concatenate([g[~common], np.zeros(len(marks), np.int64)])
        # the place within the lower 63 bits, so that heads spread over all buckets
        place = ((tokens & np.uint64((1 << 63) - 1)) >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)
        entry = np.empty(len(tokens), _ENTRY)
        entry["token"] = (tokens & np.uint64(0x7FFFFFFF)).astype(np.uint32) | ((tokens >= HEAD).astype(np.uint32) << np.uint32(31))
        entry["g"] = g
        order = np.argsort(place, kind="stable")
        place, entry = place[order], entry[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
        blobs = [entry[s:e].tobytes() for s, e in zip(begin, np.append(begin[1:], len(place)), strict=True)]
        k, n = len(blobs), len(told)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([place[begin].astype(np.int32), np.full(n, -1, np.int32)])), pa.array(blobs + [None] * n, pa.binary()), *(pa.array([None] * k + told[c].tolist(), pa.int64()) for c in ("a", "x", "y"))],
            ["bucket", "data", "a", "x", "y"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        groups: list[int] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for x in shingle_sets(s.as_py() for s in batch.column("text")):
                g = _group(x) if len(x) else None
                if g is None or g in seen:
                    continue
                seen.add(g)
                sets.append(head_of(x))
                groups.append(g)
                size += len(sets[-1])
                if size >= FLUSH_TOKENS:
                    yield packed(sets, groups)
                    sets, groups, seen, size = [], [], set(), 0
        if sets:
            yield packed(sets, groups)
        del sets, groups, seen
        give_back()

    return docs.select("text").mapInArrow(run, schema)


def _bucket_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of groups that share tokens which aren't common (m: how many), and the common tokens of groups."""
    entry = np.concatenate([np.frombuffer(d, _ENTRY) for d in rows["data"]])
    entry = np.unique(entry)  # by token, then group; the mark, group 0, among them
    token, g = entry["token"], entry["g"]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(np.append(first, len(token)))
    marked = np.zeros(len(first), bool)
    marked[np.searchsorted(first, np.flatnonzero(g == 0), side="right") - 1] = True
    common = np.repeat(marked | (counts > MOST), counts) & (g != 0)
    low = token < np.uint32(1 << 31)
    told = _common(token[common], low[common], g[common])
    usable = ~marked & (counts <= MOST)
    lefts, rights = [], []
    for n in range(2, MOST + 1):  # lists of one length at a time
        of = first[usable & (counts == n)]
        if len(of):
            lists = g[of[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            lefts.append(lists[:, i].ravel())
            rights.append(lists[:, j].ravel())
    if not lefts:
        return told
    a, b = np.concatenate(lefts), np.concatenate(rights)
    lefts.clear()
    rights.clear()
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    pair = pd.DataFrame({"a": a[begin], "b": b[begin], "m": np.diff(np.append(begin, len(a)))})
    pair["x"] = pair["y"] = 0
    return pd.concat([told, pair], ignore_index=True)


def _size_fits(a: str, b: str):
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b))


def _read_again(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of docs with the given ids."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.join(F.broadcast(ids) if n_ids <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link; sets: (rep, data)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        mask = pa.array(keep)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("data").alias("y")), "b")
    return by_batch(both.select("a", "b", "x", "y"), run, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, data): packed sets of the documents that represent a set; reps: (rep, h1, h2, doc_id)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shingle_sets(s.as_py() for s in batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_folded(x, 1) for x in found]), pa.array([_folded(x, 2) for x in found]), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "h1", "h2", "data"]
        )

    reps = written(reps, "shingle-reps")
    rows = _read_again(docs, reps.select("doc_id").distinct(), reps.count())
    made = by_batch(rows, run, "doc_id long, h1 long, h2 long, data binary")
    # an id may be repeated, with other texts or the same: each set that it represents counts, once
    return written(made.join(reps, ["doc_id", "h1", "h2"]).select("rep", "data").dropDuplicates(["rep"]), "shingle-sets")


def _connected(edges: DataFrame) -> DataFrame:
    return written(components(edges), "shingle-components")


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be connected."""
    at = groups.select("node", "component")
    return (
        pairs.join(at.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(at.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )


def _links(pairs: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links among pairs (a < b) that connect all that the pairs' links connect, with those already known.

    First each b with its least a; then only pairs across components.
    """
    first = _verify(pairs.groupBy("b").agg(F.min("a").alias("a")), sets)
    edges = written(first if known is None else first.union(known), "shingle-links")
    rest = _across(pairs, _connected(edges))
    return written(edges.union(_verify(rest, sets)), "shingle-links")


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    with scratch():
        thin, reps = _classes(docs)
        return thin, written(reps, "shingle-reps", keep=True)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2, n, ...) of documents, and of each set (h1, h2, n): its smallest doc_id, the smallest of those
    reachable by links (component_id), and its component. A set is a node by its hash, as one id may stand for several."""
    thin = written(thin_rows(docs), "shingle-rows", keep=True)
    grouped = thin.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n", "g", "low", "head").agg(F.min("doc_id").alias("doc_id"))
    classes = written(grouped.withColumn("rep", F.xxhash64("h1", "h2")), "shingle-classes")
    groups = written(classes.groupBy("g", "n", "low", "head").agg(F.min("rep").alias("rep"), F.count("*").alias("n_sets")), "shingle-groups")
    total = groups.agg(F.sum("head")).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_TOKENS))
    dealt = _deal(docs.filter("doc_id is not null"), buckets)
    # common tokens that a task told of come with a bucket of -1 and are not dealt by it
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("a"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")

    def of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            at = rows.groupby("a", sort=False)[["x", "y"]].sum().reset_index()
            return pd.DataFrame({"a": at["a"], "b": at["a"], "m": 0, "x": at["x"], "y": at["y"]}).astype("int64")
        pairs = _bucket_pairs(rows).astype("int64")
        give_back()
        return pairs

    met = written(dealt.withColumn("bucket", spread).groupBy("bucket").applyInPandas(of_bucket, "a long, b long, m long, x long, y long"), "shingle-pairs")
    told = met.filter("m = 0").groupBy(F.col("a").alias("g")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sized = groups.join(told, "g", "left").select("g", "n", "rep", "n_sets", (F.col("head") - F.coalesce("x", F.lit(0))).alias("rare"), (F.col("low") - F.coalesce("y", F.lit(0))).alias("rare_low"))
    prefix = (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1).cast("long")
    # partners of sets of up to 48 have whole sets as heads too
    enough = F.when(F.col("n") <= SMALL * 3 // 4, F.col("rare")).otherwise(F.col("rare_low")) >= prefix
    sized = written(sized.withColumn("enough", enough), "shingle-sizes")
    pairs = met.filter("m > 0").groupBy("a", "b").agg(F.sum("m").alias("m"))
    one = sized.select("g", "n", "rare_low", "n_sets", "rep", "enough")
    for side in ("a", "b"):
        pairs = pairs.join(one.select(F.col("g").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "rare_low", "n_sets", "rep", "enough"))), side)
    need = F.ceil((F.col("n_a") + F.col("n_b")) * 3 / 7)
    # of a set's rare tokens below HEAD, all but n - need are shared; two may be lost where tokens are told by fewer bits
    fits = _size_fits("n_a", "n_b") & (F.col("m") + 2 >= F.greatest(F.col("rare_low_a") - F.col("n_a") + need, F.col("rare_low_b") - F.col("n_b") + need))
    # pairs of two groups without enough such tokens come from the join of their whole sets
    pairs = pairs.filter(fits & (F.col("enough_a") | F.col("enough_b")))
    pairs = written(pairs.select("a", "b", "rep_a", "rep_b", (F.greatest("n_sets_a", "n_sets_b") > 1).alias("several")), "shingle-met")
    candidates = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    several = pairs.filter("several").select("a", "b")
    # different sets of one group; those of groups without enough such tokens come from that join, too
    lists = written(classes.join(sized.filter("n_sets > 1 and enough").select("g"), "g", "left_semi").select(F.col("g").alias("token"), "rep"), "shingle-lists")
    common_groups = written(sized.filter(~F.col("enough")).select("g"), "shingle-common")
    common = classes.join(common_groups, "g", "left_semi")
    of_several = classes.join(several.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "g", "left_semi").select("g", "rep")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("rep")).union(common.select("rep")).union(lists.select("rep")).union(of_several.select("rep")).distinct()
    sets = _sets(docs, classes.select("rep", "h1", "h2", "doc_id").join(ends, "rep", "left_semi"))
    edges = _links(candidates, sets)
    if not lists.isEmpty():
        edges = written(edges.union(_list_links(lists, sets)), "shingle-links")
    if not several.isEmpty():
        edges = written(edges.union(_group_links(several, of_several, sets, _connected(edges))), "shingle-links")
    if not common_groups.isEmpty():
        edges = _common_links(common, sets, edges)
    found = components(edges)
    of = classes.select("h1", "h2", "n", "rep", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h1", "h2", "n", "doc_id", F.coalesce("component", "rep").alias("component"))
    # written, so that a join of many sets of one component can be split
    of = written(of, "shingle-sets-of")
    least = written(of.groupBy("component").agg(F.min("doc_id").alias("component_id")), "shingle-least")
    return thin, of.join(least, "component")


def shingle_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; a document's set is its distinct
    five-word shingles, or its whole sequence if it has fewer words. Null, empty and blank texts have an empty set and
    link with nothing. Documents link when 100 * shared >= 75 * united. Equal documents are linked; rows that repeat an
    id are documents of their own under one id. A null doc_id links with nothing and has a null component. Other columns
    are ignored. Sets are 64-bit hashes.
    """
    thin, reps = _classified(docs)
    linked = thin.filter("n > 0 and doc_id is not null").join(reps.select("h1", "h2", "n", "component_id"), ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = thin.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _common_links(common: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links among sets made up of common tokens: a prefix join over whole sets, ordered from rare to common."""

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("data")]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(batch.column("rep")), [len(a) for a in arrays])), pa.array(np.concatenate(arrays)), pa.array(np.repeat([len(a) for a in arrays], [len(a) for a in arrays]))], ["rep", "token", "n"]
        )

    tokens = written(by_batch(sets.join(common.select("rep"), "rep", "left_semi").select("rep", "data"), unpack, "rep long, token long, n long"), "common-tokens")
    # Tokens that the same sets have (a passage's, say) make the same pairs, so their first in the order is enough: each
    # of these sets that has one of them in its prefix has that one there too.
    sums = [F.sum(F.xxhash64("rep", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    members = written(tokens.groupBy("token").agg(F.count("*").alias("c"), *sums).filter("c > 1"), "common-counts")
    firsts = members.groupBy("c", "s1", "s2").agg(F.min("token").alias("token")).select("token")
    counts = members.select("token", "c")
    order = Window.partitionBy("rep").orderBy("c", "token")
    # tokens of one set alone come first in the order; the others follow them
    alone = tokens.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    prefix = (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1).cast("long")
    lists = written(alone.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= prefix).filter("c > 1").select("token", "rep", "n").join(firsts, "token", "left_semi"), "common-lists")
    return written(known.union(_list_links(lists, sets)), "shingle-links")


def _list_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect all sets that link within one list; lists: (token, rep). A list's sets never become pairs."""
    lists = lists.join(_sizes(sets), "rep")
    # a long list is a triangle of blocks, each row beside every block of its list
    sizes = written(lists.groupBy("token").agg(_n_blocks().alias("k"), F.sum("bytes").alias("bytes")), "list-sizes")
    total = sizes.agg(F.sum(F.col("k") * F.col("bytes"))).first()[0] or 0
    block = F.pmod(F.xxhash64("rep", "token"), F.col("k")).cast("int")
    beside = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    placed = lists.select("token", "rep").join(sizes.select("token", "k"), "token").select("token", "rep", F.lit(_ONE_LIST).alias("side"), F.explode(beside).alias("at"))
    return _block_links(placed, sets, total)


def _group_links(several: DataFrame, members: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links between the sets of two groups that connect all that such links connect, where the groups aren't wholly
    connected yet; several: pairs (a, b) of groups, members: (g, rep). One group's blocks stand beside the other's."""
    members = written(members.join(_sizes(sets), "rep").join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "group-members")
    sizes = members.groupBy("g").agg(_n_blocks().alias("k"), F.sum("bytes").alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high"))
    pairs = several
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("g").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("k", "bytes", "low", "high"))), side)
    apart = written(pairs.filter("least(low_a, low_b) < greatest(high_a, high_b)").withColumn("token", F.xxhash64("a", "b")), "group-pairs")
    total = apart.agg(F.sum(F.col("bytes_a") * F.col("k_b") + F.col("bytes_b") * F.col("k_a"))).first()[0] or 0
    spot = F.xxhash64("rep", "token")
    one = apart.join(members.select(F.col("g").alias("a"), "rep"), "a")
    own = F.pmod(spot, F.col("k_a")).cast("int")
    left = one.select("token", "rep", F.lit(0).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("k_b") - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))).alias("at"))
    other = apart.join(members.select(F.col("g").alias("b"), "rep"), "b")
    theirs = F.pmod(spot, F.col("k_b")).cast("int")
    right = other.select("token", "rep", F.lit(1).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("k_a") - 1), lambda i: F.struct(i.alias("i"), theirs.alias("j")))).alias("at"))
    return _block_links(left.union(right), sets, total)


#: The side of sets that are compared with all others of their block; those on sides 0 and 1 are compared across.
_ONE_LIST = 2


def _sizes(sets: DataFrame) -> DataFrame:
    return sets.select("rep", F.octet_length("data").alias("bytes"))


def _n_blocks():
    return F.greatest(F.ceil(F.count("*") / LIST_BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")


def _block_links(placed: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Links within the blocks that placed(token, rep, side, at(i, j)) deals sets to; total: their bytes, copies included."""
    parts = max(1, -(-total // CALL_BYTES))
    rows = placed.select("token", "rep", "side", "at.*").join(sets.select("rep", "data"), "rep")
    return rows.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(parts)).alias("part")).applyInPandas(_compared, "a long, b long").distinct()


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest (a, b) of the links within each block of rows."""
    out = []
    for _, one in rows.groupby(["token", "i", "j"], sort=False):
        if len(one) > 1:
            side = one["side"].to_numpy()
            out += forest(one["rep"].to_numpy(np.int64), [np.frombuffer(d, np.uint64) for d in one["data"]], None if side[0] == _ONE_LIST else side == 0)
    give_back()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def forest(reps: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(rep, smallest rep it reaches) of the sets that link with another; shared tokens are counted by matrix products.

    left: marks one side, whose sets are compared with the others only; None: all are compared with all.
    """
    order = np.argsort(reps, kind="stable")
    reps, sets = reps[order], [sets[i] for i in order]
    n = len(reps)
    x = np.arange(n) if left is None else np.flatnonzero(left[order])
    y = x if left is None else np.flatnonzero(~left[order])
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(n), sizes)
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[token] > 1  # the others are in one set only
    place = np.cumsum(counts > 1) - 1
    of, token = of[shared], place[token[shared]]
    both = np.zeros((len(x), len(y)), np.float32)
    by_token = np.argsort(token, kind="stable")
    of, token = of[by_token], token[by_token]
    for a in range(0, int(counts.size and (counts > 1).sum()), 4096):
        s = slice(*np.searchsorted(token, [a, a + 4096]))
        has = np.zeros((n, 4096), np.float32)
        has[of[s], token[s] - a] = 1
        both += has[x] @ has[y].T if left is not None else has @ has.T
    links = 100 * both >= 75 * (sizes[x][:, None] + sizes[y][None, :] - both)
    label = np.arange(n)
    while len(x) and len(y):
        before = label.copy()
        label[x] = np.minimum(label[x], np.where(links, label[y][None, :], n).min(1))
        label[y] = np.minimum(label[y], np.where(links, label[x][:, None], n).min(0))
        if (label == before).all():
            break
    return [(int(reps[i]), int(reps[k])) for i, k in enumerate(label) if i != k]


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each group of linked documents has one: that with the smallest doc_id.

    Of rows that repeat that id in the group, one stays (that of the least text, then of the least row);
    documents without words link with nothing and stay, as do rows with a null doc_id. Columns may have any names; an empty
    table gives an empty one.
    """
    thin, reps = _classified(docs)
    # of a component, one set with its smallest id
    first = reps.filter("doc_id = component_id").groupBy("component", "doc_id").agg(F.min(F.struct("h1", "h2")).alias("k")).select(F.col("doc_id").alias("id"), "k.h1", "k.h2")
    empty = thin.filter("n = 0 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    twice = written(thin.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id"), "shingle-repeated")
    # a row is one column, so that no name of docs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    found = rows.join(first.select("id").union(empty).distinct(), "id", "left_semi")
    nameless = rows.filter("id is null").select("row")
    if twice.isEmpty():
        return found.select("row").union(nameless).select("row.*")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(t.as_py() for t in batch.column("text")))
        more = [[_folded(x, 1) for x in sets], [_folded(x, 2) for x in sets], [len(x) for x in sets]]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(m, pa.int64()) for m in more), batch.column("text"), batch.column("row")], ["id", "h1", "h2", "n", "text", "row"])

    schema = StructType([*(StructField(c, LongType()) for c in ("id", "h1", "h2", "n")), docs.schema["text"], found.schema["row"]])
    several = by_batch(found.join(twice, "id", "left_semi").select("id", F.col("row")["text"].alias("text"), "row"), hashed, schema)
    one = several.filter("n > 0").join(first, ["id", "h1", "h2"], "left_semi")
    one = one.groupBy("id").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row")).select("row")
    once = found.join(twice, "id", "left_anti").select("row")
    return once.union(one).union(several.filter("n = 0").select("row")).union(nameless).select("row.*")
