"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for every piece of the vocabulary. For a BPE vocabulary the best path is the one on
which every two neighbouring pieces are stable: merging their joined characters gives back just these two. A path with
an unstable pair scores minus infinity, all others zero, and exactly one path survives at each boundary. The search goes
over the text from left to right; later pieces begin in a window of the last `longest` boundaries, and as soon as the
backpointer paths of all boundaries in it meet in one boundary, the ids up to there are handed out and forgotten.

No piece crosses from another character to a word mark (U+2581), so all paths meet in front of each mark that follows
another character: there the search goes on as if it began, and what it found for the characters up to the next such place
can be looked up in a bounded cache. The same holds between any two characters that no piece has side by side. Texts are
taken in blocks, stretches without such a place in slices, so beside the ids only a block and the window are held.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import by_batch

MARK = "▁"
_INT = struct.Struct("=i")
CACHE_ENTRIES = 240_000
#: Characters of a text, and of a stretch without a meeting place, that are taken at a time; cached are stretches up to SHORT.
BLOCK, SLICE, SHORT = 1 << 16, 1 << 12, 64
_EDGE = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, from its serialized form."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        model_ = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [model_.id_to_piece(i) for i in range(model_.get_piece_size())]
        normal = [i for i in range(len(self.names)) if not (model_.is_byte(i) or model_.is_control(i) or model_.is_unknown(i) or model_.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.id_bytes = {piece: _INT.pack(i) for piece, i in self.ids.items()}
        self.scores = {self.names[i]: model_.get_score(i) for i in normal}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model_.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.low, self.high = min(self.bytes_of), max(self.bytes_of)
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("this vocabulary has pieces with a word mark after another character")
        self.silent = {i for i in range(len(self.names)) if model_.is_control(i)}
        #: the text of each id that stands for itself wherever it occurs; None for controls and parts of longer characters
        self.plain = [None if i in self.silent or self.bytes_of.get(i, 0) >= 0x80 else chr(self.bytes_of[i]) if i in self.bytes_of else n for i, n in enumerate(self.names)]
        self.stable: dict[tuple[str, str], bool] = {}
        #: 32-bit ids of chunks and parts, in two generations
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: pairs of neighbouring characters inside pieces; no piece crosses any other pair
        self.joined = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        self.pieces = ahocorasick.Automaton()
        for piece in self.ids:
            self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()

    def merged(self, chars: str) -> list[str]:
        """The encoding of a few characters by merging best-scored neighbours, leftmost first."""
        parts = list(chars)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stable(self, pair: tuple[str, str]) -> bool:
        if len(self.stable) >= CACHE_ENTRIES:
            self.stable.clear()
        known = self.stable[pair] = (self.merged(pair[0] + pair[1]) == list(pair)) if pair[0] else self.merged(pair[1]) == [pair[1]]
        return known

    def viterbi(self, blocks: Iterable[str]) -> Iterator[str]:
        """Pieces of the characters in blocks, in order, each given out once every surviving path runs through it.

        last[i]: the piece that ends at boundary i behind the last one given out, on the one path that survives there.
        root[i]: the first boundary of that path. All paths that can go on run through one boundary when the roots of the
        last `longest` boundaries are the same; before the window is that long, the beginning itself can go on.
        """
        longest, stable = self.longest, self.stable.get
        held, last, root, same = "", [""], [0], 0
        for block in blocks:
            window = held[1 - longest :]  # a piece that ends in this block begins there at the earliest
            shift = len(held) - len(window)
            held += block
            for at, piece in chain(self.pieces.iter(window + block), [(len(window) + len(block), "")]):  # by ends, longest first
                at += shift
                if at < len(last) - 1:
                    continue
                while len(last) <= at:
                    last.append(held[len(last) - 1])  # a character without a piece, given as bytes
                if piece:
                    pair = (last[at + 1 - len(piece)], piece)
                    holds = stable(pair)
                    if not (holds or holds is None and self._stable(pair)):
                        continue
                    last.append(piece)
                while len(last) > longest:
                    for b in range(len(root), len(last)):
                        start = b - len(last[b])
                        root.append(root[start] if start > 0 else b if start == 0 else -1)
                        if root[b] != root[b - 1]:
                            same = b
                    if same > len(last) - longest:
                        break
                    meet = root[-1]
                    yield last[meet]
                    held, last, root, same = held[meet:], last[meet:], [0], 0
                    shift -= meet
        path, b = [], len(held)
        while b:
            path.append(last[b])
            b -= len(last[b])
        yield from reversed(path)

    def _remember(self, chars: str, ids: bytes) -> None:
        """What is not used while the younger generation fills is forgotten. Both dictionaries stay the same objects."""
        if len(self.cache) >= CACHE_ENTRIES:
            self.older.clear()
            self.older.update(self.cache)
            self.cache.clear()
        self.cache[chars] = ids

    def _part(self, chars: str) -> bytes:
        known, out = self.id_bytes.get, []
        for piece in self.viterbi([chars] if len(chars) <= SLICE else (chars[a : a + SLICE] for a in range(0, len(chars), SLICE))):
            out.append(known(piece) or b"".join([_INT.pack(self.byte_ids[b]) for b in piece.encode("utf-8", "surrogatepass")]))
        return b"".join(out)

    def _chunk(self, chars: str) -> bytes:
        """The ids of a stretch between two marks: what is known, or what the search finds between its meeting places."""
        got = self.older.get(chars)
        if got is None:
            joined, out, start = self.joined, [], 0
            for end, pair in enumerate(zip(chars, chars[1:]), 1):
                if pair not in joined:
                    out.append(self._between(chars[start:end]))
                    start = end
            out.append(self._between(chars[start:]) if start else self._part(chars))
            got = b"".join(out)
        if len(chars) <= SHORT:
            self._remember(chars, got)
        return got

    def _between(self, part: str) -> bytes:
        ids = self.cache.get(part) or self.older.get(part)
        if ids is None:
            ids = self._part(part)
            if len(part) <= SHORT:
                self._remember(part, ids)
        return ids

    def chunks(self, block: str, marks: str = MARK) -> list[str]:
        """A block with word marks, cut in front of each mark that follows another character. marks: those in front of it;
        a text begins with one."""
        words = block.replace(MARK, " ").split(" ")
        out = []
        for word in words:
            if word:
                out.append(marks + word)
                marks = MARK
            else:
                marks += MARK
        if len(marks) > 1:
            out.append(marks[1:])
        return out

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The chunks of text, block by block; a block ends in front of a mark that follows another character."""
        at, n, marks = 0, len(text), MARK
        while at < n:
            edge = _EDGE.search(text, at + BLOCK) if at + BLOCK < n else None
            end = edge.start() if edge else n
            yield self.chunks(text[at:end] if at or end < n else text, marks)
            at, marks = end, ""

    def encoded(self, text: str) -> bytes:
        """The ids of a text, 32 bits each."""
        known, search = self.cache.get, self._chunk
        return b"".join([b"".join([known(chunk) or search(chunk) for chunk in block]) for block in self.blocks(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids. Runs of byte pieces are read as UTF-8, a wrong byte as U+FFFD; control ids give nothing."""
        plain = self.plain
        try:
            text = "".join([plain[i] for i in ids]).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        except TypeError:
            pass  # some id has no text of its own
        names, low, high = self.names, self.low, self.high
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if low <= i <= high and i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.silent:
                parts.append(names[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(4)
def _loaded(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def _kept(df: DataFrame, keep: tuple[str, ...], made: tuple[str, ...]) -> dict[str, str]:
    """Types of the columns named in keep."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if missing := [k for k in keep if k not in fields]:
        raise ValueError(f"no such column: {missing}")
    if clash := [k for k in keep if k in made] + [k for i, k in enumerate(keep) if k in keep[:i]]:
        raise ValueError(f"keep names an output column, or one twice: {clash}")
    return fields


def piece_encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, ids (array of int), n_ids, and round_trip: whether decoding the ids gives the text back.

    A null or empty text has no ids and round_trip true. A text with U+2581 reads back with a space in its place, so its
    round_trip is false. Repeated rows are encoded each; an empty table gives an empty one. Columns that aren't named in
    keep are ignored, whatever their names; ValueError where keep names an output column, or one that there isn't.
    """
    fields = _kept(docs, keep, ("ids", "n_ids", "round_trip"))
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", ids array<int>, n_ids long, round_trip boolean"

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _loaded(path)
        texts = [s.as_py() or "" for s in batch.column(len(keep))]
        ids = [codec.encoded(t) for t in texts]
        same = [codec.decode(np.frombuffer(i, np.int32).tolist()) == t for i, t in zip(ids, texts, strict=True)]
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), np.int32)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sizes), pa.array(same, pa.bool_())],
            [*keep, "ids", "n_ids", "round_trip"],
        )

    def forget() -> None:
        codec = _loaded(path)
        codec.cache.clear()
        codec.older.clear()

    return by_batch(docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("__text")), encode, schema, after=forget)


def piece_decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and text: what the column ids decodes to; null ids give an empty text. keep as in piece_encode()."""
    fields = _kept(encoded, keep, ("text",))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _loaded(path)
        texts = [codec.decode(s.as_py() or []) for s in batch.column(len(keep))]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return by_batch(encoded.select(*[F.col(f"`{k}`") for k in keep], F.col("ids").alias("__ids")), decode, ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", text string")
