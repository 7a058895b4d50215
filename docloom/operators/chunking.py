"""Chunks of texts: arrays of struct(text, index, start_offset, token_estimate), offsets in bytes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import estimate_tokens

CHUNK = "struct<text:string,index:int,start_offset:int,token_estimate:long>"
CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("start_offset", T.IntegerType()), T.StructField("token_estimate", T.LongType())]))


def _chunk(text: Column, index: Column, start: Column) -> Column:
    own = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.struct(own.alias("text"), index.cast("int").alias("index"), start.cast("int").alias("start_offset"), estimate_tokens(own).alias("token_estimate"))


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters, each size - overlap (or 1) after the last, up to the first that reaches the end; blank ones drop out."""
    step = size - overlap if overlap < size else 1
    n = F.length(text)
    if size <= 0:
        return F.array().cast(f"array<{CHUNK}>")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    windows = F.filter(F.transform(starts, lambda s: F.struct(s.alias("s"), F.substring(text, s + 1, F.lit(size)).alias("t"))), lambda w: F.trim(w["t"]).rlike(r"\S"))
    return F.transform(windows, lambda w, i: _chunk(w["t"], i, F.octet_length(F.substring(text, F.lit(1), w["s"]))))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines; blank ones drop out but keep their index."""
    parts = F.split(text, "\n\n", -1)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{CHUNK}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["at"] + F.octet_length(p["t"]) + 2).alias("at"), F.concat(acc["out"], F.array(_chunk(p["t"], p["i"], acc["at"]))).alias("out"))

    numbered = F.transform(parts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.filter(F.aggregate(numbered, first, step)["out"], lambda c: c["text"] != "")


# Sentence boundaries of Unicode Standard Annex 29, by the Sentence_Break property. A paragraph separator ends a sentence,
# and so does a terminator with closing marks and spaces behind it, unless what follows says that it goes on.
_PARAGRAPH = r"(?:\r\n|[\p{SB=SE}\p{SB=CR}\p{SB=LF}])"
_IGNORED = r"[\p{SB=EX}\p{SB=FO}]*+"
_END = regex.compile(rf"{_PARAGRAPH}|(?:(?P<stop>\p{{SB=AT}})|\p{{SB=ST}}){_IGNORED}(?P<after>(?:\p{{SB=CL}}{_IGNORED})*+(?:\p{{SB=SP}}{_IGNORED})*+)(?P<paragraph>{_PARAGRAPH})?")
_GOES_ON = regex.compile(r"[\p{SB=SC}\p{SB=AT}\p{SB=ST}]")
_LOWER_FOLLOWS = regex.compile(r"[^\p{SB=LE}\p{SB=UP}\p{SB=LO}\p{SB=SE}\p{SB=CR}\p{SB=LF}\p{SB=AT}\p{SB=ST}]*+\p{SB=LO}")
_NUMBER, _CAPITAL = regex.compile(r"\p{SB=NU}"), regex.compile(r"\p{SB=UP}")
_CASED_BEFORE = regex.compile(rf"(?r)[\p{{SB=UP}}\p{{SB=LO}}]{_IGNORED}")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Places in characters of the sentences that hold a letter or a digit, with the white space behind them."""
    out, start = [], 0

    def add(end: int) -> None:
        nonlocal start
        if any(map(str.isalnum, text[start:end])):
            out.append((start, end))
        start = end

    for m in _END.finditer(text):
        end = m.end()
        if m["after"] is not None and m["paragraph"] is None:
            if _GOES_ON.match(text, end):
                continue
            if m["stop"]:
                if not m["after"] and (_NUMBER.match(text, end) or _CAPITAL.match(text, end) and _CASED_BEFORE.match(text, 0, m.start())):
                    continue
                if _LOWER_FOLLOWS.match(text, end):
                    continue
        add(end)
    if start < len(text):
        add(len(text))
    return out


def tokens_of(text: str) -> int:
    return math.floor(len(text.split()) * 1.3 + 0.5)


def _sentence_chunks(text: str, most: int) -> list[tuple[str, int, int, int]]:
    out, now, start, held = [], [], 0, 0
    at = done = 0  # bytes of the characters before done

    def flush() -> None:
        if own := " ".join(now).strip():
            out.append((own, len(out), start, tokens_of(own)))

    for a, b in sentence_spans(text):
        at += len(text[done:a].encode())
        done = a
        sentence = text[a:b]
        n = tokens_of(sentence)
        if now and held + n > most:
            flush()
            now, held = [], 0
        if not now:
            start = at
        now.append(sentence)
        held += n
    flush()
    return out


def sentence_chunks(text: Column, max_tokens: int = 500) -> Column:
    """Whole sentences gathered up to max_tokens (sums of the sentences' own estimates); a longer sentence stands alone."""

    @F.pandas_udf(CHUNKS)
    def run(texts):
        return texts.map(lambda t: _sentence_chunks(t or "", max_tokens))

    return run(text)


def semantic_chunks(text: Column, target_tokens: int = 500) -> Column:
    return sentence_chunks(text, target_tokens)


def _recursive_chunks(text: str, separators: tuple[str, ...], most: int) -> list[tuple[str, int, int, int]]:
    parts = [(text, 0)]
    for sep in separators:
        split = []
        for part, at in parts:
            if tokens_of(part) <= most:
                split.append((part, at))
                continue
            for piece in part.split(sep):
                split.append((piece, at))
                at += len(piece.encode()) + len(sep.encode())
        parts = split
    out, now, start = [], "", 0
    for part, at in parts:
        if now and tokens_of(f"{now} {part}") > most:
            if own := now.strip():
                out.append((own, len(out), start, tokens_of(own)))
            now = ""
        if not now:
            start = at
        now = f"{now} {part}" if now else part
    if own := now.strip():
        out.append((own, len(out), start, tokens_of(own)))
    return out


def recursive_chunks(text: Column, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), max_tokens: int = 500) -> Column:
    """Parts over max_tokens are split by one separator after the other, then neighbours merge while they fit."""

    @F.pandas_udf(CHUNKS)
    def run(texts):
        return texts.map(lambda t: _recursive_chunks(t or "", separators, max_tokens))

    return run(text)


@dataclass(frozen=True)
class Fixed:
    size: int
    overlap: int = 0

    def column(self, text: Column) -> Column:
        return fixed(text, self.size, self.overlap)


@dataclass(frozen=True)
class Sentence:
    max_tokens: int = 500

    def column(self, text: Column) -> Column:
        return sentence_chunks(text, self.max_tokens)


@dataclass(frozen=True)
class Paragraph:
    def column(self, text: Column) -> Column:
        return paragraphs(text)


@dataclass(frozen=True)
class Recursive:
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    max_tokens: int = 500

    def column(self, text: Column) -> Column:
        return recursive_chunks(text, self.separators, self.max_tokens)


@dataclass(frozen=True)
class Semantic:
    target_tokens: int = 500

    def column(self, text: Column) -> Column:
        return semantic_chunks(text, self.target_tokens)


Strategy = Fixed | Sentence | Paragraph | Recursive | Semantic


def chunk(text: Column, strategy: Strategy = Sentence()) -> Column:
    """The chunks of a text by a strategy that is a value."""
    return strategy.column(text)
