"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated, centred principal components are balanced
codes that lose little (iterative quantisation: alternate signs and an orthogonal Procrustes solution). Codes are cut into
substrings of w bits, each with a table of its own; vectors whose substrings differ in at most r bits meet in a bucket.
w and r are chosen from the number of vectors so that a pair at the threshold is met with probability 0.9 or more, at the
least expected work; that probability is measured on pairs made from the sample, since centring widens angles.

Buckets are filled with codes alone: of the pairs that meet there, those whose whole codes differ in more bits than pairs at
the threshold do drop out, and only vectors that are left with a partner are fetched and compared by cosine in double
precision. A pair that meets in several tables counts in the first of them, which both codes tell, so a vector is fetched
for that one.

No pair becomes a row. A bucket is a grid of blocks of bounded size, a block pair is one matrix product, and what leaves it
are sums of links for each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.tables import by_batch, scratch, written

#: Vectors of one block of a bucket; rows of codes, and bytes of vectors, that one call takes, about.
BLOCK, CALL_ROWS, CALL_BYTES = 1024, 60_000, 16_000_000
#: Share of pairs at the threshold whose codes may be told apart from those of unlike vectors by their distance.
REACHED = 0.995


@dataclass(frozen=True)
class Search:
    threshold: float = 0.9
    #: vectors of the sample that rotations are learned from, about
    sample: int = 20_000
    recall: float = 0.9
    rounds: int = 30
    most_rotations: int = 8
    seed: int = 3
    #: share of bits in which a pair at the threshold differs; None: that of the angle between the original vectors
    differ: float | None = None


@dataclass(frozen=True)
class Tables:
    """words codes of `bits` bits; substrings of width bits that may differ in radius places; first words in reach places."""

    words: int
    bits: int
    width: int
    radius: int
    reach: int = 64

    @property
    def per_word(self) -> int:
        return self.bits // self.width

    @property
    def count(self) -> int:
        return self.words * self.per_word

    def substring(self, codes: np.ndarray, t: int) -> np.ndarray:
        """Of an array of codes, one column for each word."""
        return (codes[..., t // self.per_word] >> np.int64(t % self.per_word * self.width)) & np.int64((1 << self.width) - 1)

    def flips(self) -> list[int]:
        return [sum(1 << b for b in c) for k in range(self.radius + 1) for c in combinations(range(self.width), k)]


def choose(n: int, bits: int, search: Search) -> Tables:
    """The cheapest tables that meet a pair at the threshold with the wanted probability."""
    differ = math.acos(search.threshold) / math.pi if search.differ is None else search.differ
    best, cost = None, math.inf
    for words in range(1, search.most_rotations + 1):
        for width in range(min(4, bits), min(bits, 32) + 1):
            for radius in range(3):
                hit = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(min(radius, width) + 1))
                tables = words * (bits // width)
                if 1 - (1 - hit) ** tables < search.recall + 0.02:
                    continue
                probes = sum(math.comb(width, k) for k in range(min(radius, width) + 1))
                # work: rows moved, products of two vectors, and a fixed part for each bucket
                now = tables * (n * (1 + probes * (radius > 0)) * 20 + n * probes * (n / 2**width) * 0.05 + min(n, 2**width) * 200)
                if now < cost:
                    best, cost = Tables(words, bits, width, min(radius, width)), now
    return best or Tables(1, min(bits, 4), min(bits, 4), min(bits, 4))  # all pairs meet


def learn(sample: np.ndarray, bits: int, words: int, search: Search) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean, and for each word a matrix from a centred unit vector to the numbers whose signs are its bits."""
    mean = sample.mean(0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    principal = vectors[:, ::-1][:, :bits]
    v = x @ principal
    out = []
    r = np.random.default_rng(search.seed)
    for _ in range(words):
        rotation = np.linalg.qr(r.normal(size=(bits, bits)))[0]
        for _ in range(search.rounds):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            rotation = (left @ right).T
        out.append(principal @ rotation)
    return mean, out


def _codes(x: np.ndarray, mean: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """For each word, the codes of unit vectors."""
    return [((((x - mean) @ m) >= 0) * (1 << np.arange(m.shape[1], dtype=np.uint64))).sum(1).astype(np.uint64).view(np.int64) for m in matrices]


def at_threshold(sample: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold, that differ as vectors of the sample differ from its mean."""
    r = np.random.default_rng(search.seed)
    x = sample[r.permutation(len(sample))[:4000]]
    t = (sample - sample.mean(0))[r.integers(0, len(sample), len(x))]
    t = t - (t * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(t, axis=1, keepdims=True)
    good = size[:, 0] > 1e-9
    x, t = x[good], t[good] / size[good]
    return x, search.threshold * x + math.sqrt(1 - search.threshold**2) * t


def met(tables: Tables, x: list[np.ndarray], y: list[np.ndarray]) -> float:
    """The share of pairs with codes x and y that meet in some table."""
    x, y = np.stack(x, 1), np.stack(y, 1)
    hit = np.zeros(len(x), bool)
    for t in range(tables.count):
        hit |= np.bitwise_count(tables.substring(x, t) ^ tables.substring(y, t)) <= tables.radius
    return (hit & (_apart(x[:, 0], y[:, 0]) <= tables.reach)).mean() if len(x) else 1.0


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits codes differ."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def fitted(n: int, bits: int, sample: np.ndarray, search: Search) -> tuple[Tables, np.ndarray, list[np.ndarray]]:
    """Tables, mean and matrices that meet pairs at the threshold as often as wanted, measured on such pairs.

    Centring widens angles of vectors with a common mean, so the share of differing bits is that of codes, and is raised
    until the tables chosen for it reach the wanted share. Whole codes may differ in as many bits as those of nearly all these
    pairs do (with a sample of under 1000, in any); the wanted share counts what is lost by that.
    """
    x, y = at_threshold(sample, search)
    mean, matrices = learn(sample, bits, 1, search)
    unlike = _apart(_codes(x, mean, matrices)[0], _codes(y, mean, matrices)[0])
    differ = max(math.acos(search.threshold) / math.pi, float(unlike.mean()) / bits if len(x) else 0.0)
    while True:
        tables = choose(n, bits, replace(search, differ=min(differ, 0.5)))
        mean, matrices = learn(sample, tables.bits, tables.words, search)
        x_codes, y_codes = _codes(x, mean, matrices), _codes(y, mean, matrices)
        tables = replace(tables, reach=math.ceil(np.quantile(_apart(x_codes[0], y_codes[0]), REACHED)) if len(x) >= 1000 else tables.bits)
        if differ >= 0.5 or met(tables, x_codes, y_codes) >= search.recall + 0.02:
            return tables, mean, matrices
        differ *= 1.05


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame, vec: str, kind: str) -> DataFrame:
    """vec_id, raw bytes, dim and key of all vectors; raw and key are null for those that can't have links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw: list[bytes | None] = []
        dims = []
        for v in batch.column(1):
            values = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and not v.values.null_count else np.empty(0, kind)
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(values.astype(np.float64))
            good = len(values) and np.isfinite(norm) and norm > 0
            raw.append(values.tobytes() if good else None)
            dims.append(len(values))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "raw", "dim"])

    rows = by_batch(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec), run, "vec_id long, raw binary, dim int")
    return rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("raw")))


_PLACE = ["t", "bucket", "x_block", "y_block"]


def _met_first(tables: Tables, t: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of codes x and y (a column for each word), met in table t, are near enough and not met in a table before."""
    close = _apart(x[:, None, 0], y[None, :, 0]) <= tables.reach
    for s in range(t):
        if not close.any():
            break
        close &= np.bitwise_count(tables.substring(x, s)[:, None] ^ tables.substring(y, s)[None, :]) > tables.radius
    return close


def _sides(one: pd.DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block pair's rows: those of x and of y; a block beside itself is both."""
    if tables.radius == 0 and one["x_block"].iloc[0] == one["y_block"].iloc[0]:
        every = np.arange(len(one))
        return every, every
    side = one["side"].to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _with_partner(tables: Tables):
    """Rows of a call's block pairs that have a partner by their codes."""
    names = [f"code{i}" for i in range(tables.words)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = []
        rows = rows.sort_values([*_PLACE, "rep", "side"], kind="stable", ignore_index=True)
        key = rows[_PLACE].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(rows)]
        codes, reps = rows[names].to_numpy(np.int64), rows["rep"].to_numpy()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            x, y = _sides(rows.iloc[a:b], tables)
            x, y = x + a, y + a
            close = _met_first(tables, int(key[a, 0]), codes[x], codes[y])
            close &= reps[x][:, None] != reps[y][None, :]
            kept += [x[close.any(1)], y[close.any(0)]]
        found = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
        return rows.iloc[found][["rep", *_PLACE, "side"]]

    return run


def _block_links(tables: Tables, kind: str, threshold: float):
    """Links of the vectors of a call's block pairs."""
    names = [f"code{i}" for i in range(tables.words)]

    def block(one: pd.DataFrame) -> pd.DataFrame | None:
        x, y = _sides(one, tables)
        if not len(x) or not len(y):
            return None
        xi, yi, codes = one["rep"].to_numpy()[x], one["rep"].to_numpy()[y], one[names].to_numpy(np.int64)
        units = _units(one["raw"].tolist(), kind)
        close = (units[x] @ units[y].T >= threshold) & (xi[:, None] != yi[None, :])
        if close.any():
            close &= _met_first(tables, int(one["t"].iloc[0]), codes[x], codes[y])
        links = close @ one["weight"].to_numpy(np.int64)[y]
        # labels of connected vectors: the smallest rep that is reached
        far = np.iinfo(np.int64).max
        lx, ly = xi.copy(), yi.copy()
        while close.any():
            ly_ = np.minimum(ly, np.where(close, lx[:, None], far).min(0))
            lx_ = np.minimum(lx, np.where(close, ly_[None, :], far).min(1))
            if (lx_ == lx).all() and (ly_ == ly).all():
                break
            lx, ly = lx_, ly_
        on_y = close.any(0)
        found = links > 0
        return pd.DataFrame({"a": np.concatenate([xi[found], yi[on_y]]), "b": np.concatenate([lx[found], ly[on_y]]), "links": np.concatenate([links[found], np.zeros(int(on_y.sum()), np.int64)])})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [block(one) for _, one in rows.groupby(_PLACE, sort=False)]
        parts = [p for p in parts if p is not None and len(p)]
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")

    return run


def near_vectors(vectors: DataFrame, search: Search = Search(), vec: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at cosine >= threshold. n_links counts other vectors linked directly, component_id is the smallest vec_id
    reachable by links, kept tells vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and vectors of different lengths don't link. Equal vectors are compared once and count
    each; rows that repeat a vec_id are vectors of their own under one id. A null vec_id has no links, a null component and
    isn't kept. Other columns are ignored; an empty table gives an empty one.
    """
    with scratch():
        return _near_vectors(vectors, search, vec)


def _near_vectors(vectors: DataFrame, search: Search, vec: str) -> DataFrame:
    spark = vectors.sparkSession
    kind = "<f8" if "double" in vectors.schema[vec].dataType.simpleString() else "<f4"
    rows = _usable(vectors, vec, kind)
    # equal vectors are one node, named by a hash of their bytes
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.min("raw").alias("raw"), F.min("dim").alias("dim"))
    classes = written(classes.withColumn("rep", F.xxhash64("key")), "vector-classes")
    members = written(rows.select("vec_id", "key"), "vector-members", keep=True)
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    found = None
    for dim, n in sorted(sizes.items()):
        one = classes.filter(F.col("dim") == dim)
        every = max(1, -(-n // search.sample))
        some = [bytes(r["raw"]) for r in one.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("raw").collect()] if n > 1 else []
        if not some:
            continue
        tables, mean, matrices = fitted(n, min(64, dim), _units(some, kind), search)
        part = _links(one, dim, tables, mean, matrices, kind, search.threshold)
        found = part if found is None else found.union(part)
    links = spark.createDataFrame([], "a long, b long, links long") if found is None else found
    sums = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = written(components(links.select("a", "b").filter("a <> b")), "vector-components")
    # tables of their own, so that a join of many vectors of one component or class can be split
    by_class = classes.select("key", "rep", "weight", "first").join(sums, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = written(by_class.select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-found")
    least = written(by_class.groupBy("component").agg(F.min("first").alias("component_id")), "vector-least")
    told = written(by_class.join(least, "component").select("key", "n_links", "component_id"), "vector-told", keep=True)
    linked = members.filter("key is not null").join(told, "key").select("vec_id", "n_links", "component_id")
    alone = members.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, tables: Tables, mean: np.ndarray, matrices: list[np.ndarray], kind: str, threshold: float) -> DataFrame:
    """(a, b, links): sums of links of a, and edges of spanning forests where a <> b; classes are of one length."""
    names = [f"code{i}" for i in range(tables.words)]

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _codes(_units(batch.column("raw").to_pylist(), kind), mean, matrices)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in codes)], [*batch.schema.names, *names])

    coded = by_batch(classes.select("rep", "weight", "raw"), encode, "rep long, weight long, raw binary, " + ", ".join(f"{c} long" for c in names))
    coded = written(coded, "vector-codes")
    mask = (1 << tables.width) - 1
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(f"code{t // tables.per_word}", t % tables.per_word * tables.width).bitwiseAND(F.lit(mask)).alias("bucket")) for t in range(tables.count)))
    own = coded.select("rep", *names, F.explode(keys).alias("k")).select("rep", *names, "k.t", "k.bucket")
    counted = own.groupBy("t", "bucket").agg(F.count("*").alias("n"))
    salt = F.xxhash64("rep", "t")
    grid = F.sequence

    def blocks(n: str):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    if tables.radius == 0:
        large = written(counted.filter(F.col("n") > BLOCK).select("t", "bucket", blocks("n").alias("m")), "large-buckets")
        placed = own.join(large, ["t", "bucket"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("i", F.pmod(salt, F.col("m")).cast("int"))
        # as x (0) beside every y block, as y (1) beside every x block; the block beside itself once
        as_x = F.transform(grid(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("i").alias("x_block"), j.alias("y_block"), F.lit(0).alias("side")))
        as_y = F.transform(F.filter(grid(F.lit(0), F.col("m") - 1), lambda j: j != F.col("i")), lambda j: F.struct(j.alias("x_block"), F.col("i").alias("y_block"), F.lit(1).alias("side")))
        rows = placed.select("rep", *names, "t", "bucket", F.explode(F.concat(as_x, as_y)).alias("g"))
        moved = counted.select(F.col("n") * (2 * blocks("n") - 1))
    else:
        flips = F.array(*(F.lit(f).cast("long") for f in tables.flips()))
        probes = own.withColumn("flip", F.explode(flips)).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("flip"))).drop("flip")
        both = counted.join(probes.groupBy("t", "bucket").agg(F.count("*").alias("nx")), ["t", "bucket"])
        sized = written(both.filter("nx > 1").select("t", "bucket", "n", "nx", blocks("n").alias("m"), blocks("nx").alias("mx")), "buckets")
        x = probes.join(sized, ["t", "bucket"]).select("rep", *names, "t", "bucket", F.explode(F.transform(grid(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.pmod(salt, F.col("mx")).cast("int").alias("x_block"), j.alias("y_block"), F.lit(0).alias("side")))).alias("g"))
        y = own.join(sized, ["t", "bucket"]).select("rep", *names, "t", "bucket", F.explode(F.transform(grid(F.lit(0), F.col("mx") - 1), lambda j: F.struct(j.alias("x_block"), F.pmod(salt, F.col("m")).cast("int").alias("y_block"), F.lit(1).alias("side")))).alias("g"))
        rows = x.union(y)
        moved = sized.select(F.col("n") * F.col("mx") + F.col("nx") * F.col("m"))
    moved = moved.toDF("rows").agg(F.sum("rows")).first()[0] or 0
    met = rows.select("rep", *names, "t", "bucket", "g.*").groupBy(_call(moved, CALL_ROWS)).applyInPandas(_with_partner(tables), "rep long, t int, bucket long, x_block int, y_block int, side int")
    met = written(met, "vector-partners")
    found = met.join(coded, "rep").groupBy(_call(met.count(), max(64, CALL_BYTES // (dim * 8)))).applyInPandas(_block_links(tables, kind, threshold), "a long, b long, links long")
    return written(found, "vector-links")


def _call(rows: int, most: int):
    """Which call compares a block pair."""
    return F.pmod(F.xxhash64(*_PLACE), F.lit(max(1, -(-rows // most)))).alias("call")
