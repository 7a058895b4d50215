"""Format detection from bytes or text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("unknown", "plaintext", "markdown", "html", "pdf", "docx", "epub")
# Names of formats that a caller may hint.
HINTS = {"txt": "plaintext", "text": "plaintext", "plaintext": "plaintext", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "epub": "epub"}


def looks_like_markdown(text: Column) -> Column:
    """A mark of Markdown in one of the first 40 lines, white space at their left aside."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 40), lambda s: F.regexp_replace(s, r"^\s+", ""))
    return F.exists(lines, lambda s: s.rlike(r"^(#[ 0-9]|```|[-*] )") | (s.contains("](") & s.contains("[")))


def detect_text_format(text: Column) -> Column:
    left = F.regexp_replace(text, r"^\s+", "")
    head = F.lower(F.substring(left, 1, 32))
    tag = left.startswith("<") & F.substring(text, 1, 2048).contains("</")
    return (
        F.when(text.isNull(), "unknown")
        .when(left == "", "plaintext")
        .when(head.startswith("<!doctype html") | head.startswith("<html") | tag, "html")
        .when(looks_like_markdown(text), "markdown")
        .otherwise("plaintext")
    )


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; wrong bytes give U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def detect_format(content: Column) -> Column:
    """Of a binary column: magic bytes first, then the text; no bytes are unknown."""
    start = F.hex(F.substring(content, 1, 4096))

    def holds(word: str) -> Column:
        return start.contains(word.encode().hex().upper())

    zipped = F.when(holds("mimetypeapplication/epub"), "epub").otherwise("docx")
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "unknown")
        .when(start.startswith(b"%PDF-".hex().upper()), "pdf")
        .when(start.startswith(b"PK\x03\x04".hex().upper()), zipped)
        .otherwise(detect_text_format(decoded(content)))
    )


def with_hint(detected: Column, hint: str | None) -> Column:
    """The hinted format; an unknown hint leaves the detected one."""
    known = HINTS.get((hint or "").lower())
    return F.lit(known) if known else detected
