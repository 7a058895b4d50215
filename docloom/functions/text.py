"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of term counts, and endings removed by the light stemmer, first match first.
STOP_WORDS = (
    "a an the and or but is are was were be been being have has had do does did will would could should may might must shall "
    "can need dare ought used to of in for on with at by from as into through during before after above below between this "
    "that these those i you he she it we they what which who whom whose when where why how all each every both few more most "
    "other some such no not only own same so than too very just also"
).split()
SUFFIXES = ("ations", "ation", "ization", "izing", "ized", "ness", "tion", "ions", "ing", "ied", "ies", "ed", "er", "est", "ly", "s")


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded half up."""
    return F.round(word_count(text) * F.lit(1.3).cast("double")).cast("long")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markdown(text: Column) -> Column:
    """Without heading marks at line starts and without the characters * ` _ >."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^#+\s+", ""), r"[*`_>]", "")


def title(text: Column) -> Column:
    """The first level-one heading, or null."""
    found = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found)


def sentences(text: Column) -> Column:
    """Array of sentences: white space collapsed, split after . ! or ? and a space."""
    return F.filter(F.split(collapse_ws(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def stem(word: Column) -> Column:
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Array of stems: lower case, split at anything but a-z and 0-9, longer than two, no stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), stem)


def embed_terms(text: Column) -> Column:
    """Array of lower-case runs of letters and digits of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def fnv1a(data: Column) -> Column:
    """struct(hi, lo): the halves of the 64-bit FNV-1a hash of a text's bytes."""
    digits = F.hex(F.encode(data, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        # times 2**40 + 435, in two halves
        x = acc["lo"].bitwiseXOR(b)
        low = x * 435
        high = acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(each, start, step)


def title_case_key(key: Column) -> Column:
    """Each run of characters between white space, _ and - with an upper-case first letter and lower-case rest."""
    runs = F.regexp_extract_all(key, F.lit(r"[^\s_-]+|[\s_-]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def is_valid_key(key: Column) -> Column:
    return (key != "") & (F.octet_length(key) <= 40) & ~key.rlike(r"[.,]$") & ~key.contains("://") & ~key.contains("@") & key.rlike(r"^\p{IsAlphabetic}")
