"""Graph-ranked sentences: summaries, key points and keywords.

Sentences are vectors of term counts; their cosines are the weights of a graph without loops, and 60 rounds of PageRank
score them. The graph is never built: a round multiplies by the sparse unit vectors and their transpose and takes the
diagonal off, so a text costs time and memory in proportion to its terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.parts import cuts, in_parts
from docloom.functions.text import STOP_WORDS, SUFFIXES

# By level, the share of sentences kept, key points, and keywords.
LEVELS = {"light": (0.60, 3, 5), "medium": (0.35, 5, 8), "aggressive": (0.15, 7, 12)}
DAMPING, ROUNDS = 0.85, 60
_STOP = frozenset(STOP_WORDS)


@dataclass(frozen=True)
class Options:
    level: str = "medium"
    max_sentences: int | None = None
    max_key_points: int | None = None
    max_keywords: int | None = None
    min_sentence_words: int = 4
    weighting: str = "tf"


def stem(word: str) -> str:
    for s in SUFFIXES:
        if word.endswith(s) and len(word) > len(s) + 2:
            return word[: -len(s)]
    return word


#: Words whose term a worker keeps; terms of sentences that are ranked in one go.
KNOWN_WORDS, CELLS = 200_000, 20_000
_known: dict[str, str | None] = {}


def _term(word: str) -> str | None:
    if len(_known) >= KNOWN_WORDS:
        _known.clear()
    found = _known[word] = None if word in _STOP else stem(word)
    return found


_WORDS = re.compile("[a-z0-9]{3,}").findall


def terms(text: str) -> list[str]:
    known = _known.get
    found = [known(w) or _term(w) for w in _WORDS(text.lower())]
    return [t for t in found if t]


def split(text: str) -> list[str]:
    if "#" in text:
        text = re.sub(r"(?m)^#+\s+", "", text)
    for mark in "*`_>":
        text = text.replace(mark, "")
    return sentences(text)


def sentences(text: str) -> list[str]:
    """White space collapsed, split after . ! or ? and a space."""
    text = " ".join(text.split())
    for mark in ".!?":
        text = text.replace(mark + " ", mark + "\n")
    return text.split("\n") if text else []


def rank(bags: list[list[str]], weighting: str = "tf") -> np.ndarray:
    """PageRank scores of sentences given as terms."""
    return next(rank_all([bags], weighting))


def rank_all(texts: Sequence[list[list[str]]], weighting: str = "tf") -> Iterator[np.ndarray]:
    """rank() of each text. Texts are laid side by side as one graph of many parts, up to CELLS terms of sentences in one
    go; a score sums the same numbers in the same order as if its text stood alone."""
    lengths: list[int] = []
    sizes: list[int] = []  # of sentences: different terms
    col: list[int] = []
    value: list[int] = []
    of: list[int] = []  # of texts: different terms
    start = 0
    for bags in texts:
        number: dict[str, int] = {}
        for bag in bags:
            counted: dict[str, int] = {}
            for t in bag:
                counted[t] = counted.get(t, 0) + 1
            sizes.append(len(counted))
            col += [number.setdefault(t, len(number)) + start for t in counted]
            value += counted.values()
        lengths.append(len(bags))
        of.append(len(number))
        start += len(number)
        if len(col) >= CELLS:
            yield from _ranks(lengths, sizes, col, value, of, weighting)
            lengths, sizes, col, value, of, start = [], [], [], [], [], 0
    yield from _ranks(lengths, sizes, col, value, of, weighting)


def _ranks(lengths: list[int], sizes: list[int], cols: list[int], values: list[int], of: list[int], weighting: str) -> list[np.ndarray]:
    if not lengths:
        return []
    own = np.repeat(np.array(lengths, np.float64), lengths)  # of sentences: sentences of their text
    n, m, col = len(sizes), sum(of), np.array(cols, np.int64)
    row = np.repeat(np.arange(n), sizes)
    value = np.array(values, np.float64)
    if weighting == "tfidf":
        value = value * np.log(np.repeat(np.array(lengths, np.float64), of) / np.maximum(1, np.bincount(col, minlength=m)))[col]
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = np.divide(value, norm[row], out=np.zeros_like(value), where=norm[row] > 0)
    diagonal = np.bincount(row, value * value, n)

    def similar(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * np.bincount(col, value * v[row], m)[col], n) - diagonal * v

    sums = similar(np.ones(n))
    sums[np.abs(sums) < 1e-9] = 0.0
    inverse = np.divide(1.0, sums, out=np.zeros(n), where=sums > 0)
    score, least = 1 / own, (1 - DAMPING) / own
    for _ in range(ROUNDS):
        score = least + DAMPING * similar(score * inverse)
    return np.split(score, np.cumsum(lengths[:-1]))


def order(scores: np.ndarray) -> np.ndarray:
    """Best first; scores that agree to nine places go by position."""
    return np.argsort(-np.round(scores, 9), kind="stable")


@dataclass(frozen=True)
class Ranked:
    """What all levels share of one text."""

    title: str | None
    sentences: list[str]
    bags: list[list[str]]
    scores: np.ndarray
    words: np.ndarray


def ranked_all(texts: Sequence[str], weighting: str = "tf") -> Iterator[Ranked]:
    found = [split(t) for t in texts]
    bags = [[terms(s) for s in own] for own in found]
    for text, own, bag, scores in zip(texts, found, bags, rank_all(bags, weighting), strict=True):
        m = re.search(r"(?m)^#\s+(.+)$", text) if "#" in text else None
        yield Ranked(m[1].strip() if m else None, own, bag, scores, np.array([len(s.split()) for s in own], np.int64))


def ranked(text: str, weighting: str = "tf") -> Ranked:
    return next(ranked_all([text], weighting))


def summary_places(r: Ranked, o: Options) -> list[int]:
    """The sentences of a summary, in order."""
    n = len(r.sentences)
    target = max(1, int(np.floor(n * LEVELS[o.level][0] + 0.5))) if o.max_sentences is None else o.max_sentences
    able = r.words >= o.min_sentence_words
    level = n > 0 and bool((np.round(r.scores, 9) == np.round(r.scores[0], 9)).all())
    return sorted([int(i) for i in order(r.scores) if able[i] or level][:target])


def frequent(bags: list[list[str]], most: int) -> list[str]:
    """The terms that occur most, ties by place."""
    return [t for t, _ in sorted(Counter(chain.from_iterable(bags)).items(), key=itemgetter(1), reverse=True)[:most]]


def picked(r: Ranked, o: Options) -> dict:
    """title, summary, key_points, keywords and counts at one level."""
    _, points, keys = LEVELS[o.level]
    n, scores = len(r.sentences), r.scores
    combined = 0.7 * scores / max(1e-9, scores.max(initial=0)) + 0.3 * (1 - np.arange(n) / max(1, n)) if n else scores
    best = sorted([i for i in order(combined) if r.words[i] >= o.min_sentence_words][: points if o.max_key_points is None else o.max_key_points])
    keywords = frequent(r.bags, keys if o.max_keywords is None else o.max_keywords)
    summary = " ".join(r.sentences[i] for i in summary_places(r, o))
    original, reduced = int(r.words.sum()), len(summary.split())
    return {
        "title": r.title, "summary": summary, "key_points": [r.sentences[i] for i in best], "keywords": keywords,
        "original_words": original, "reduced_words": reduced, "reduction_percent": (1 - reduced / original) * 100 if original else 0.0, "original_sentences": n,
    }


def reduce_text(text: str, o: Options) -> dict:
    return picked(ranked(text, o.weighting), o)


REDUCED = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("key_points", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType()))]
    + [T.StructField("original_words", T.LongType()), T.StructField("reduced_words", T.LongType()), T.StructField("reduction_percent", T.DoubleType()), T.StructField("original_sentences", T.LongType())]
)


def reduced(text: Column, options: Options = Options()) -> Column:
    """struct of reduce_text(); the power iteration is numeric work on each text, so it is an Arrow function without a shuffle."""
    return in_parts(lambda texts: [picked(r, options) for r in ranked_all([t or "" for t in texts], options.weighting)], REDUCED)(text)


def keywords(text: Column, options: Options = Options()) -> Column:
    """The keywords of reduce_text(), which need no ranks."""
    most = LEVELS[options.level][2] if options.max_keywords is None else options.max_keywords
    return in_parts(lambda texts: [frequent([terms(s) for s in split(t or "")], most) for t in texts], T.ArrayType(T.StringType()))(text)


def sentence_scores(text: Column, weighting: str = "tf") -> Column:
    """array<double>: the score of each sentence."""
    return in_parts(lambda texts: list(rank_all([[terms(s) for s in split(t or "")] for t in texts], weighting)), T.ArrayType(T.DoubleType()))(text)


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, term, tf) of docs(doc_id, text): how often each term is in each sentence, white space being ASCII's.

    A row's terms are counted where it is read; only where an id stands in several rows are their counts added up.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def counted(text: str) -> list[Counter]:
        text = _SPACE.sub(" ", re.sub(r"(?m)^#+[ \t\n\x0b\f\r]+", "", text) if "#" in text else text)
        for mark in "*`_>":
            text = text.replace(mark, "")
        text = _SPACE.sub(" ", text).strip(" ")
        for mark in ".!?":
            text = text.replace(mark + " ", mark + "\n")
        return [Counter(terms(s)) for s in text.split("\n") if s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch.column(1)):
                found = [counted(t or "") for t in batch.column(1).slice(at, n).to_pylist()]
                sizes = [len(c) for own in found for c in own]
                idx = np.repeat(np.array([i for own in found for i in range(len(own))], np.int64), sizes)
                place = np.repeat(np.arange(at, at + n), [sum(map(len, own)) for own in found])
                term = pa.array([t for own in found for c in own for t in c], pa.string())
                tf = pa.array([x for own in found for c in own for x in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(idx), term, tf], ["doc_id", "idx", "term", "tf"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, idx long, term string, tf long")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "idx", "term").agg(F.sum("tf").alias("tf"))
