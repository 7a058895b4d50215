"""Compression: filler phrases out, then the lowest-ranked sentences while a text has too many words."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.parts import in_parts
from docloom.operators.textrank import rank_all, sentences, terms

# Phrases that compression takes out, in either case.
FILLERS = ("in order to", "due to the fact that", "at this point in time", "it is important to note that", "as a matter of fact", "for the most part", "in other words", "basically", "actually", "essentially", "literally", "needless to say")
_FILLER = r"(?i)\b(?:" + "|".join(FILLERS) + r")\b,?\s*"
_FIND = re.compile(_FILLER.replace(r"\s", "[ \t\n\x0b\f\r]"))


def without_fillers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, _FILLER, ""), r"\s+", " "))


def _short(text: str) -> str:
    """text without fillers, white space collapsed."""
    lower = text.lower()
    if not text.isascii() or any(f in lower for f in FILLERS):
        text = _FIND.sub("", text)
    return " ".join(text.split())


def _best(sentences: list[str], scores: Sequence[float], most: int) -> str:
    """The best sentences while they have at most `most` words; one stays, order too."""
    total, kept = 0, []
    for i in sorted(range(len(sentences)), key=lambda i: (-round(scores[i], 9), i)):
        total += len(sentences[i].split())
        if kept and total > most:
            break
        kept.append(i)
    return " ".join(sentences[i] for i in sorted(kept) if sentences[i])


def compress_sentences(sentences: list[str], scores: Sequence[float], ratio: float) -> str:
    """The sentences without fillers, of which those with the lowest scores go while more than ratio of all words is left."""
    return _best([_short(s) for s in sentences], scores, math.ceil(sum(len(s.split()) for s in sentences) * ratio))


def compress_text(text: str, ratio: float) -> str:
    """Fillers out, then, while the text has more than ratio of its original words, its lowest-ranked sentence out; one stays."""
    return compress_texts([text], ratio)[0]


def compress_texts(texts: Sequence[str], ratio: float) -> list[str]:
    """compress_text() of each."""
    found = [sentences(_short(t)) for t in texts]
    scores = rank_all([[terms(s) for s in own] for own in found])
    return [_best(own, score.tolist(), math.ceil(len(t.split()) * ratio)) for t, own, score in zip(texts, found, scores, strict=True)]


def compressed(text: Column, ratio: float) -> Column:
    """compress_text(); a null text is empty."""
    return in_parts(lambda texts: compress_texts([t or "" for t in texts], ratio), T.StringType())(text)


def compressed_document(doc: Column, ratio: float) -> Column:
    """A parsed document whose paragraphs, plain parts and quotes are compressed each; headings, code and lists stay."""
    from docloom.sources.parse import DOCUMENT

    @F.pandas_udf(DOCUMENT)
    def run(docs):
        rows = docs.to_dict("records")
        for row in rows:
            row["sections"] = [{**s, "blocks": [{**b, "text": compress_text(b["text"], ratio)} if b["kind"] in ("paragraph", "plain", "quote") and b["text"] else b for b in s["blocks"]]} for s in (row["sections"] if row["sections"] is not None else [])]
        import pandas as pd

        return pd.DataFrame(rows, columns=DOCUMENT.names)

    return run(doc)
