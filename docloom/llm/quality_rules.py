"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines.

Words are numbered by first occurrence in their text, and for each n-gram length a rolling polynomial hash modulo 2**64
over these numbers, a difference of prefix sums per window in numpy, finds windows that occur more than once. Coverage is
the share of a text's word characters that lie in such windows other than their first occurrence. Windows of three words
are compared exactly for the base rule, not by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import by_batch

SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Texts beyond any of these are not kept. Coverages are shares of word characters, from 0 to 1."""

    min_words: int = 50
    repeat_percent: int = 50
    #: n-gram length, from 1 -> most coverage by repeated windows after their first occurrence
    coverage: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.28), (10, 0.26))
    line_coverage: float = 0.30
    symbols_per_word: float = 0.25

    def __post_init__(self) -> None:
        if any(k < 1 for k, _ in self.coverage):
            raise ValueError("n-grams have one word at least")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _later(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    ordered = keys[order]
    again[order[1:]] = ordered[1:] == ordered[:-1]
    return again


def _spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """The words covered by windows of the given length that start at marked places."""
    steps = np.zeros(n + 1, np.int32)
    steps[: len(starts)] += starts
    steps[length : length + len(starts)] -= starts
    return np.cumsum(steps[:n]) > 0


def rolling_hashes(ids: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, one hash per window: sum of mixed(id) * ODD**position, scaled to the window's start."""
    n = len(ids)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, _ODD, np.uint64)) if n else np.ones(1, np.uint64)
        power = np.concatenate([np.ones(1, np.uint64), power[:-1]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:n])])
        # windows are compared after scaling all of them to the last position
        return {k: (sums[k:] - sums[:-k]) * power[n - k :: -1][: n - k + 1] if n >= k else np.empty(0, np.uint64) for k in lengths}


def measure(text: str, lengths: tuple[int, ...]) -> tuple[int, int, int, int, int, float, dict[int, float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coverage by repeated lines, coverage by length."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup_lines += 1
                dup_chars += len(line) - sum(map(line.count, SPACES))
            else:
                seen.add(line)
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        if len(number) < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            keys = pairs[:-1] * np.int64(len(number)) + ids[2:]
        again = _later(keys)
        twice = again | np.isin(keys, keys[again]) if again.any() else again
        repeated = int(_spread(twice, 3, n).sum())
    share = dict.fromkeys(lengths, 0.0)
    if repeated or min(lengths, default=3) < 3:  # a repeated longer window holds repeated windows of three words
        length = np.fromiter((len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))[ids]
        total = max(1, int(length.sum()))
        for k, h in rolling_hashes(ids, lengths).items():
            if len(h) > 1:
                share[k] = float(length[_spread(_later(h), k, n)].sum()) / total
    return n, chars, symbols, dup_lines, repeated, dup_chars / max(1, chars), share


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, the measures of its whole text, base_failed and kept.

    Words are runs of characters other than space and U+0009 to U+000D. n_dup_lines counts lines with a word that equal
    an earlier line; n_repeat_words counts words in any three-word window found at least twice, its first place included.
    base_failed: fewer than min_words words, or more than repeat_percent % of them such words. kept: not base_failed, and
    no coverage or symbol limit passed. A null or empty text has no words and fails. Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty one.
    """
    lengths = tuple(k for k, _ in limits.coverage)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, " + ", ".join(f"coverage_{k} double" for k in lengths) + ", base_failed boolean, kept boolean"

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for s in batch.column("text"):
            n, chars, symbols, dup_lines, repeated, lines, share = measure(s.as_py() or "", lengths)
            failed = n < limits.min_words or 100 * repeated > limits.repeat_percent * n
            kept = not failed and lines <= limits.line_coverage and symbols <= limits.symbols_per_word * n and all(share[k] <= most for k, most in limits.coverage)
            rows.append((n, chars, symbols, dup_lines, repeated, lines, *share.values(), failed, kept))
        names = [p.split()[0] for p in schema.split(", ")]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in columns)], names)

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judge, schema)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns, in one pass and without a shuffle; repeated rows each.
    Columns of any name pass through; an empty table gives an empty one."""
    lengths = tuple(k for k, _ in limits.coverage)

    def good(text: str | None) -> bool:
        n, _, symbols, _, repeated, lines, share = measure(text or "", lengths)
        return n >= limits.min_words and 100 * repeated <= limits.repeat_percent * n and lines <= limits.line_coverage and symbols <= limits.symbols_per_word * n and all(share[k] <= most for k, most in limits.coverage)

    place = docs.columns.index("text")
    return by_batch(docs, lambda batch: batch.filter(pa.array([good(s.as_py()) for s in batch.column(place)], pa.bool_())), docs.schema)
