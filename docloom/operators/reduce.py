"""Reduction of documents over bytes: parse, summarise, compress, render; at one level or several from one parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.parts import in_parts
from docloom.functions.text import word_count
from docloom.operators.compression import compress_sentences, compressed
from docloom.operators.textrank import LEVELS, REDUCED, Options, Ranked, picked, ranked_all, summary_places
from docloom.providers import AbstractiveProvider, Parsers
from docloom.sources.parse import full_text, read_documents


def render(summary: Column, key_points: Column, kind: str) -> Column:
    """plaintext: summary and listed points; markdown: with a bold caption; json: the summary alone."""
    if kind == "json":
        return summary
    listed = F.array_join(F.transform(key_points, lambda k: F.concat(F.lit("- "), k)), "\n")
    if kind == "markdown":
        return F.trim(F.when(F.size(key_points) > 0, F.concat(summary, F.lit("\n\n**Key points**\n\n"), listed)).otherwise(summary))
    return F.when(F.size(key_points) > 0, F.concat(summary, F.lit("\n\nKey points:\n"), listed, F.lit("\n"))).otherwise(summary)


def export_markdown(title: Column, summary: Column, key_points: Column) -> Column:
    """A page of its own: title (Summary without one), summary, and a section of key points."""
    listed = F.array_join(F.transform(key_points, lambda k: F.concat(F.lit("- "), k)), "\n")
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Summary")), F.lit("\n\n"), summary, F.lit("\n\n## Key points\n"), listed)


def metrics(original: Column, reduced_words: Column) -> Column:
    """struct(original_words, reduced_words, retention_ratio, reduction_percent), zeros where there was nothing."""
    ratio = F.when(original > 0, reduced_words / original).otherwise(0.0)
    return F.struct(original.alias("original_words"), reduced_words.alias("reduced_words"), ratio.alias("retention_ratio"), F.when(original > 0, (1 - ratio) * 100).otherwise(0.0).alias("reduction_percent"))


LEVEL = T.StructType([T.StructField("level", T.StringType()), *REDUCED.fields, T.StructField("compressed", T.StringType())])


def _ratio(o: Options) -> float:
    """A summary keeps the level's share of its words in compression, half at least."""
    return max(LEVELS[o.level][0], 0.5)


def reduced_levels(text: Column, options: Sequence[Options]) -> Column:
    """An array with one struct for each of options: the level, what picked() has, and the compressed summary. The text is
    split and ranked once; compression drops the summary's sentences that rank lowest in the text."""

    def run(texts: list[str | None]) -> list[list[dict]]:
        told = [t or "" for t in texts]
        ranks = {w: list(ranked_all(told, w)) for w in dict.fromkeys(o.weighting for o in options)}
        return [[one(ranks[o.weighting][i], o) for o in options] for i in range(len(told))]

    def one(found: Ranked, o: Options) -> dict:
        places = summary_places(found, o)
        short = compress_sentences([found.sentences[i] for i in places], [float(found.scores[i]) for i in places], _ratio(o))
        return {"level": o.level, **picked(found, o), "compressed": short}

    return in_parts(run, T.ArrayType(LEVEL))(text)


def reduce_levels(df: DataFrame, options: Sequence[Options], kind: str = "plaintext", hint: str | None = None, parsers: Parsers | None = None, abstractive: AbstractiveProvider | None = None) -> DataFrame:
    """reduce_documents() at several levels from one parse: a row for each document and level."""
    docs = read_documents(df, hint=hint, parsers=parsers)
    rows = docs.select("doc_id", "format", F.col("doc.title").alias("doc_title"), F.col("doc.error").alias("error"), full_text(F.col("doc"), ("code",)).alias("text"))
    rows = rows.select("*", F.explode(reduced_levels(F.col("text"), options)).alias("r")).drop("text")
    summary = F.col("r.compressed")
    if abstractive is not None:
        parts = [F.when(F.col("r.level") == o.level, compressed(F.col("told"), _ratio(o))) for o in options]
        rows = rows.withColumn("told", abstractive.column(F.col("r.summary")))
        summary = F.coalesce(*parts)
    rows = rows.withColumn("summary", summary)
    measured = F.struct(
        metrics(F.col("r.original_words"), word_count(F.col("summary"))).alias("m"),
        F.col("r.original_sentences").alias("original_sentences"), F.size("r.key_points").cast("long").alias("key_points"), F.size("r.keywords").cast("long").alias("keywords"),
    )
    flat = F.struct(*(measured["m"][c].alias(c) for c in ("original_words", "reduced_words", "retention_ratio", "reduction_percent")), *(measured[c].alias(c) for c in ("original_sentences", "key_points", "keywords")))
    return rows.select("doc_id", F.col("r.level").alias("level"), "format", F.coalesce("doc_title", "r.title").alias("title"), "summary", render(F.col("summary"), F.col("r.key_points"), kind).alias("output"), "r.key_points", "r.keywords", flat.alias("metrics"), "error")


def reduce_documents(df: DataFrame, options: Options = Options(), kind: str = "plaintext", hint: str | None = None, parsers: Parsers | None = None, abstractive: AbstractiveProvider | None = None) -> DataFrame:
    """df(doc_id, content) with format, title, summary, output, key_points, keywords, metrics and error; parse, summarise, compress, render.

    Code blocks have no part in a summary. abstractive: rewrites the extracted summary before it is compressed.
    """
    return reduce_levels(df, [options], kind, hint, parsers, abstractive).drop("level")
