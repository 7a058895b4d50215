"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.oracles import ORACLES
from docloom.llm.page_text import page_text
from docloom.llm.piece_codec import piece_encode
from docloom.llm.quality_net import fit, score
from docloom.llm.quality_rules import quality_rules
from docloom.llm.secret_scan import secret_scan
from docloom.llm.shingle_join import shingle_components
from docloom.llm.source_mixing import Mix, mixed, word_count
from docloom.llm.tables import read
from docloom.llm.token_counts import token_counts
from docloom.llm.url_filter import url_filter
from docloom.llm.vector_dedup import near_vectors

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixed(docs, Mix()).select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), "mix_epoch", "mix_block", "mix_order")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = fit(docs, labels.filter(~held_out))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode(read(spark, sf_dir, "documents"), vocabulary(PIECE_FILE))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary(BPE_FILE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_source_mixing, op2_vector_dedup, op3_quality_net, op4_shingle_join, op5_secret_scan, op6_url_filter, op7_piece_codec, op8_quality_rules, op9_page_text, op10_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:  # the others are tested against brute force in tests/llm
    return dict(ORACLES)
