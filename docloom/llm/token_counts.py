"""Token counts at every prefix, by dynamic programming.

Byte-pair encoding has a prefix property: of all tokens that end at a given byte, exactly one can be the last token of
the encoding of the bytes up to there, namely the one whose pair with the last token of the shorter prefix is stable (the
two tokens' joined bytes encode to just these two). So one left-to-right pass gives, for every prefix, its last token and
its exact token count, without encoding any prefix on its own. Counts, truncation points and budgets are then look-ups.

The pieces into which the vocabulary's pattern splits a text are encoded apart, so a piece's counts hold wherever it
occurs; they are kept in a bounded cache that is emptied when full, which changes no result. A text's table is the sum of
whole pieces before each place and the count within its piece. Where a prefix is split otherwise than the whole text is
(inside a run of white space, a contraction, a special token's string), the table holds what the prefix alone encodes to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import by_batch

#: Pieces, and pairs, kept by a worker; pieces up to SHORT characters are kept.
CACHE_ENTRIES, SHORT = 600_000, 64
#: Characters of a text whose table is worked out at a time.
BLOCK = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary given as the text of a tokenizer's JSON file."""

    def __init__(self, source: str):
        import ahocorasick
        import public_tokenizers

        spec = json.loads(source)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.tokens = {as_bytes(k) for k in spec["model"]["vocab"] if all(c in letters for c in k)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.ends = ahocorasick.Automaton()  # bytes stand as Latin-1 characters
        for token in self.tokens:
            self.ends.add_word(token.decode("latin-1"), token)
        self.ends.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.runs = regex.compile(r"\s\s+").finditer
        self.edge = regex.compile(r"(?<=\S)\s").search
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        #: 32-bit counts at the end of each character of a piece
        self.cache: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a few bytes by the merges themselves."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stable(self, pair: tuple[bytes, bytes]) -> bool:
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= CACHE_ENTRIES:
                self.stable.clear()
            known = self.stable[pair] = self.merged(pair[0] + pair[1]) == [t for t in pair if t]
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one piece."""
        last: list[bytes] = [b""]
        counts = [0]
        stable = self.stable.get
        for at, token in self.ends.iter(data.decode("latin-1")):  # by ends, longest first
            if at < len(last) - 1:
                continue
            start = at + 1 - len(token)
            if start >= len(last):
                break
            pair = (last[start], token)
            holds = stable(pair)
            if holds or holds is None and self._stable(pair):
                last.append(token)
                counts.append(counts[start] + 1)
        if len(counts) <= len(data):
            raise ValueError(f"no token of the vocabulary ends a prefix of {data[: len(counts)]!r}")
        return counts

    def _piece(self, piece: str) -> bytes:
        """Counts at the end of each character of one piece, 32 bits each; a prefix is split as a text of its own."""
        known = self.cache.get(piece)
        if known is not None:
            return known
        counts = np.array(self.prefixes(piece.encode("utf-8", "surrogatepass")), np.int32)
        if not piece.isascii():
            counts = counts[np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in piece)])]
        counts = counts[1:]
        if piece[0] == "'" and piece[1:].isalpha():  # of a contraction's prefixes, only the whole is one piece
            for k in range(1, len(piece)):
                counts[k - 1] = sum(self.prefixes(p.encode())[-1] for p in self.find(piece[:k]))
        known = counts.tobytes()
        if len(piece) <= SHORT:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = known
        return known

    def _plain(self, text: str) -> np.ndarray:
        """Counts at the end of each character of a text without special tokens."""
        known, search = self.cache.get, self._piece
        pieces = self.find(text)
        if not pieces:
            return np.empty(0, np.int64)
        within = np.frombuffer(b"".join([known(p) or search(p) for p in pieces]), np.int32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = within[np.cumsum(sizes) - 1].astype(np.int64)
        counts = within + np.repeat(np.cumsum(totals) - totals, sizes)
        for run in self.runs(text):  # the end of a prefix makes one piece of the white space in front of it
            a, b = run.span()
            counts[a:b] = np.frombuffer(search(run[0]), np.int32) + (counts[a - 1] if a else 0)
        return counts

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts of a text that are split as the whole is: each ends in front of white space behind another character."""
        at = 0
        while at < len(text):
            found = self.edge(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = found.start() if found else len(text)
            yield text[at:end] if at or end < len(text) else text
            at = end

    def tables(self, text: str) -> Iterator[np.ndarray]:
        """Counts at the end of each character of text, in blocks."""
        total = 0
        parts = [text]
        if any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        tail, before = "", 0  # what the part before ends with, from its last edge on; the tokens in front of that
        for i, part in enumerate(parts):
            if i % 2:
                cut = [before + int(self._plain(tail + part[:k])[-1]) for k in range(1, len(part))]
                total += 1
                tail, before = "", total
                yield np.array([*cut, total], np.int64)
                continue
            for block in self._blocks(part):
                counts = self._plain(block) + total
                if len(parts) > 1:
                    cut = max((m.start() for m in regex.finditer(r"(?<=\S)\s", block)), default=0)
                    tail, before = block[cut:], int(counts[cut - 1]) if cut else total
                total = int(counts[-1])
                yield counts

    def at_every_prefix(self, text: str) -> np.ndarray:
        """counts[i]: tokens that text[:i] encodes to."""
        return np.concatenate([np.zeros(1, np.int64), *self.tables(text)])

    def count(self, text: str) -> int:
        last = 0
        for counts in self.tables(text):
            last = int(counts[-1])
        return last

    def measured(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of text, and the longest prefix, in characters, that encodes to budget tokens at most."""
        at = n = cut = 0
        for counts in self.tables(text):
            fits = np.flatnonzero(counts <= budget)
            if len(fits):
                cut = at + int(fits[-1]) + 1
            at += len(counts)
            n = int(counts[-1])
        return n, cut


@lru_cache(4)
def _loaded(path: str) -> PrefixCounter:
    with open(path, encoding="utf-8") as f:
        return PrefixCounter(f.read())


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit, and cut_chars, the longest prefix that fits the limit.

    A null text is an empty one: no bytes, no tokens. Repeated rows are counted each; other columns are ignored; an empty
    table gives an empty one. path is the vocabulary's file, present on every machine with the tokenizer package; it is
    1.5 MB, whatever the input. Of a long text, the table of a block is in memory at a time.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _loaded(path)
        texts = [s.as_py() or "" for s in batch.column("text")]
        found = [counter.measured(t, limit) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([n > limit for n, _ in found], pa.bool_()), pa.array([c for _, c in found], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
        )

    return by_batch(_texts(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts: counts[i] tokens in the first i + 1 characters; none for a null or empty text.

    A stored table answers questions of budgets by fits() alone, without a tokenizer.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _loaded(path)
        made = [np.concatenate([np.empty(0, np.int64), *counter.tables(s.as_py() or "")]).astype(np.int32) for s in batch.column("text")]
        ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], ["doc_id", "counts"])

    return by_batch(_texts(docs), run, "doc_id long, counts array<int>")


def fits(counts: Column, budget: Column | int) -> Column:
    """The longest prefix, in characters, of at most budget tokens, from a stored table."""
    within = F.transform(counts, lambda c, i: F.when(c <= budget, i + 1))
    return F.coalesce(F.array_max(within), F.lit(0))


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs with each text cut to its longest prefix of at most budget tokens; a null text stays null."""
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _loaded(path)
        columns = list(batch.columns)
        columns[place] = pa.array([None if t is None else t[: counter.measured(t, budget)[1]] for t in columns[place].to_pylist()], columns[place].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return by_batch(docs, run, docs.schema)
