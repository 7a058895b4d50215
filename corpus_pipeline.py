"""Quality rules, near-duplicate removal, secret redaction, source mixing and tokenisation of a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.piece_codec import piece_encode
from docloom.llm.quality_rules import keep_good
from docloom.llm.queries import PIECE_FILE, vocabulary
from docloom.llm.secret_scan import redacted
from docloom.llm.shingle_join import keep_one
from docloom.llm.source_mixing import Mix, mixed
from docloom.llm.tables import drop, read, scratch, written


# Every stage: documents may be null or empty, of any length, and repeated; what is stated for the operator holds. An empty
# table gives an empty one, and columns that the stage does not use pass through whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; repeated rows are judged each, null and empty texts go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; documents without words stay."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in text replaced by their kind."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources that the mix weighs up are repeated, twice at most."""
    return mixed(docs, Mix(repeats=2.0, budget="cover")).select([F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of each document's pieces; a null or empty text has none."""
    return piece_encode(docs, vocabulary(PIECE_FILE), keep=("doc_id", "lang", "source"))


STAGES = [("quality_rules", quality), ("shingle_join", near_duplicates), ("secret_scan", secrets), ("source_mixing", mix), ("piece_encoding", tokens)]

#: SQL can't express the rolling hashes' verdicts or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table replaces the one before; what a stage writes beside it goes with it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            made = written(stage(spark, docs, sf_dir), name, keep=True)
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
