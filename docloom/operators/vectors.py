"""Embeddings, similarity, search, re-ranking and answers from passages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.parts import cuts

DIM = 256
#: Questions that are held against the vectors in one pass; scores that one product makes, and its vectors; terms whose hash a worker keeps.
BLOCK_QUERIES, PRODUCT, PART, KNOWN_TERMS = 10_000, 1_000_000, 1_000, 200_000

_SPLIT = regex.compile(r"[^\p{L}\p{N}]+").split
_hashes: dict[str, int] = {}


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for c in data:
        h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _term_hash(word: str) -> int:
    """-1 for a term of one byte or none."""
    if len(_hashes) >= KNOWN_TERMS:
        _hashes.clear()
    data = word.encode("utf-8", "surrogatepass")
    h = _hashes[word] = fnv1a(data) if len(data) > 1 else -1
    return h


def hash_vector(text: str, dim: int) -> np.ndarray:
    """Unit vector of signed term counts by hash bucket, in single precision; zeros for a text without terms.

    Terms are lower-case runs of letters and digits of more than one byte; bit 32 of a term's hash gives its sign.
    """
    known = _hashes.get
    hashed = [h if (h := known(w)) is not None else _term_hash(w) for w in _SPLIT(text.lower())]
    h = np.array([x for x in hashed if x >= 0], np.uint64)
    signs = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1))
    sums = np.bincount((h % np.uint64(dim)).astype(np.int64), signs, dim)
    norm = np.sqrt((sums * sums).sum())
    return (sums / norm if norm > 0 else sums).astype(np.float32)


def hash_embed(text: Column, dim: int = DIM) -> Column:
    """hash_vector() of each text, as one Arrow function: no shuffle, each distinct term hashed once by a worker."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at, n in cuts(batch):
                flat = np.concatenate([hash_vector(t or "", dim) for t in batch.slice(at, n).to_pylist()])
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))

    return run(text)


def embed_rows(df: DataFrame, key: list[str], text: str = "text", dim: int = DIM) -> DataFrame:
    """Rows of key with `embedding`."""
    return df.select(*key, hash_embed(F.col(text), dim).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty or zero ones."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    """Over the places that both have."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d * d))


def _stacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of questions; zeros stay zeros."""
    stack = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(stack, axis=1, keepdims=True)
    return np.array([r["query_id"] for r in rows]), np.divide(stack, norms, out=np.zeros_like(stack), where=norms > 0)


def _best(question: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates, the k best of each question; scores that agree to twelve places go by vec_id."""
    order = np.lexsort((vec, -np.round(score, 12), question))
    question, score, vec = question[order], score[order], vec[order]
    first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]])) if len(question) else np.empty(0, np.int64)
    place = np.arange(len(question)) - np.repeat(first, np.diff(np.append(first, len(question))))
    return question[place < k], score[place < k], vec[place < k]


def _nearest(ids: np.ndarray, unit: np.ndarray, k: int):
    """A task's k best vectors of each question, kept over its batches."""

    def run(batches):
        held = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        floor = np.full(len(ids), -np.inf)  # of questions: the score that a vector needs to be among the best so far
        step = max(1, min(PART, PRODUCT // max(1, len(ids))))
        for batch in batches:
            vec, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a in range(0, len(vec), step):
                part = column.slice(a, step)
                fits = pc.fill_null(pc.equal(pc.list_value_length(part), unit.shape[1]), False)
                x = np.zeros((len(part), unit.shape[1]))
                x[fits.to_numpy(zero_copy_only=False)] = part.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, unit.shape[1])
                x[~np.isfinite(x).all(1)] = 0
                n = np.linalg.norm(x, axis=1, keepdims=True)
                scores = unit @ np.divide(x, n, out=x, where=n > 0).T
                rounded = np.round(scores, 12)
                least = floor if len(part) <= k or np.isfinite(floor).all() else np.maximum(floor, np.partition(rounded, -k, axis=1)[:, -k])
                question, place = np.nonzero(rounded >= least[:, None])
                if not len(question):
                    continue
                held = _best(np.append(held[0], question), np.append(held[1], scores[question, place]), np.append(held[2], vec[a + place]), k)
                full = np.bincount(held[0], minlength=len(ids)) >= k
                last = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True))
                floor[held[0][last]] = np.where(full[held[0][last]], np.round(held[1][last], 12), -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], pa.int64()), pa.array(held[2], pa.int64()), pa.array(held[1], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of largest cosine for each query, ties by vec_id.

    queries(query_id, embedding) go to every task in blocks of about BLOCK_QUERIES, one pass over the vectors for each
    block; a task scores them by matrix products and hands on its own k best, from which the ranks come. A vector of
    another length than the queries', null, zero or not a number scores 0; a query without an embedding finds nothing.
    """
    context = queries.sparkSession.sparkContext
    queries = queries.filter("embedding is not null")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    found, dims = [], set()
    for b in range(blocks if n else 0):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = some.select("query_id", "embedding").collect()
        dims |= {len(r["embedding"]) for r in rows}
        if len(dims) > 1:
            raise ValueError("queries have embeddings of different lengths")
        if rows:
            block = context.broadcast(_stacked(rows))
            found.append(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lambda batches, block=block: _nearest(*block.value, k)(batches), "query_id long, vec_id long, score double"))
    if not found or k < 1:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    every = reduce(DataFrame.union, found)
    if min_score is not None:
        every = every.filter(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank_mmr(results: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, vec_id, score, rank) ordered anew: weight * score - (1 - weight) * closeness to those already taken.

    results(query_id, vec_id, score, rank, embedding) has the few candidates of a query, so a query is one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        near = np.nan_to_num(x @ x.T)
        score = np.nan_to_num(pdf["score"].to_numpy())
        left, taken = list(range(len(pdf))), []
        while left:
            gain = [round(weight * score[i] - (1 - weight) * max([0.0, *near[i, taken]]), 12) for i in left]
            taken.append(left.pop(int(np.argmax(gain))))
        out = pdf.loc[taken, ["query_id", "vec_id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return results.groupBy("query_id").applyInPandas(one, "query_id long, vec_id long, score double, rank int")


def sources(results: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, sources): the passages in rank order up to the first that passes the budget in bytes, as an array of
    struct(rank, vec_id, text, score) and what else of doc_id and start_offset results has; none may fit."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.octet_length("text")).over(order) <= budget
    fields = ["rank", *(c for c in ("vec_id", "text", "score", "doc_id", "start_offset") if c in results.columns)]
    return results.withColumn("held", held).groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("held"), F.struct(*fields)))).alias("sources"))


def context(results: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, context, n_sources): the sources as a block of numbered lines."""
    lines = F.transform("sources", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"], F.lit("\n")))
    return sources(results, budget).select("query_id", F.array_join(lines, "").alias("context"), F.size("sources").alias("n_sources"))


# The texts around a question and its passages.
NOTHING_FOUND = ('No relevant passages were found to answer: "', '". Try ingesting more documents or rephrasing the question.')
FOUND = ("Based on ", ' retrieved passage(s), here is what the document says about "', '":\n\n', "\n\n(Generated by the local-echo placeholder. Configure an LLM Generator for synthesized answers.)")


def answer(question: Column, passages: Column, n_sources: Column) -> Column:
    """A fixed answer that cites the passages; a note where nothing was retrieved (a null number of sources)."""
    nothing = F.concat(F.lit(NOTHING_FOUND[0]), question, F.lit(NOTHING_FOUND[1]))
    text = F.concat(F.lit(FOUND[0]), n_sources.cast("string"), F.lit(FOUND[1]), question, F.lit(FOUND[2]), passages, F.lit(FOUND[3]))
    return F.when(n_sources.isNull(), nothing).otherwise(text)
