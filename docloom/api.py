"""The library's verbs: over files and tables, for one document at a time, and from SQL."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import __version__
from docloom.functions.entities import PATTERNS, find_entities
from docloom.functions.fields import extracted, tables
from docloom.operators import vectors as V
from docloom.operators.chunking import Sentence, Strategy, _recursive_chunks, _sentence_chunks, chunk
from docloom.operators.reduce import reduce_documents
from docloom.operators.textrank import Options
from docloom.providers import EchoGenerator, EmbeddingProvider, Generator, HashEmbedder
from docloom.sources.parse import lines_text, parsed, read_documents

KINDS = tuple(PATTERNS)


def version() -> str:
    return __version__


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, content) of the files under a path that Spark reads; doc_id is the file's path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def extract_documents(df: DataFrame, with_tables: bool = True, with_fields: bool = True, with_entities: bool = True) -> DataFrame:
    """df(doc_id, content) with format, result (tables, key_values, entities, field_count, confidence, provider) and error."""
    docs = read_documents(df)
    return docs.select("doc_id", "format", extracted(lines_text(F.col("format"), F.col("content"), F.col("doc")), with_tables, with_fields, with_entities).alias("result"), F.col("doc.error").alias("error"))


def to_json(df: DataFrame, pretty: bool = True) -> DataFrame:
    """One column, json, with each row as an object."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": str(pretty).lower()}).alias("json"))


def _one(spark: SparkSession, data: bytes | str) -> DataFrame:
    content = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else bytes(data)
    return spark.createDataFrame([(0, bytearray(content))], "doc_id long, content binary")


def _checked(row: dict) -> dict:
    if row["error"]:
        raise ValueError(row["error"])
    return {k: v for k, v in row.items() if k not in ("doc_id", "error")}


def reduce(spark: SparkSession, data: bytes | str, options: Options = Options(), output_format: str = "markdown", hint: str | None = None) -> dict:
    """One document's reduction; ValueError where it can't be parsed. Many documents: operators.reduce.reduce_documents."""
    return _single(reduce_documents(_one(spark, data), options, output_format, hint))


def _single(df: DataFrame) -> dict:
    return _checked(df.first().asDict(recursive=True))


def reduce_files(spark: SparkSession, path: str | list[str], options: Options = Options(), output_format: str = "markdown", hint: str | None = None) -> DataFrame:
    """One row per file; one that can't be parsed has its reason in error."""
    return reduce_documents(read_files(spark, path), options, output_format, hint)


def extract(spark: SparkSession, data: bytes | str, with_tables: bool = True, with_fields: bool = True, with_entities: bool = True) -> dict:
    """One document's format, tables, fields and entities; ValueError where it can't be parsed."""
    return _single(extract_documents(_one(spark, data), with_tables, with_fields, with_entities))


def extract_text(spark: SparkSession, text: str) -> dict:
    """Tables, fields and entities of a text as it is, without parsing."""
    return spark.createDataFrame([(text,)], "text string").select(extracted(F.col("text")).alias("r")).first()["r"].asDict(recursive=True)


@dataclass(frozen=True)
class Rag:
    """Questions answered from the passages of documents.

    chunks: (vec_id, doc_id, text, start_offset), vectors: (vec_id, embedding). vec_id is a hash of the document's id and
    the chunk's index. Both are plain DataFrames, so they can be written and read again between runs. embedder and
    generator may be the user's own.
    """

    chunks: DataFrame
    vectors: DataFrame
    embedder: EmbeddingProvider = HashEmbedder()
    generator: Generator = EchoGenerator()
    budget: int = 4000

    @classmethod
    def ingest(cls, docs: DataFrame, strategy: Strategy = Sentence(), embedder: EmbeddingProvider = HashEmbedder(), generator: Generator = EchoGenerator(), budget: int = 4000) -> Rag:
        """docs: (doc_id, text). strategy: how texts are cut."""
        made = docs.select("doc_id", F.explode(chunk(F.col("text"), strategy)).alias("c"))
        made = made.select(F.xxhash64("doc_id", "c.index").alias("vec_id"), "doc_id", "c.text", "c.start_offset")
        return cls(made, made.select("vec_id", embedder.column(F.col("text")).alias("embedding")), embedder, generator, budget)

    def add(self, other: Rag) -> Rag:
        if other.embedder.dim != self.embedder.dim:
            raise ValueError("vectors have different lengths")
        return replace(self, chunks=self.chunks.unionByName(other.chunks), vectors=self.vectors.unionByName(other.vectors))

    def clear(self) -> Rag:
        """The same without any passage."""
        return replace(self, chunks=self.chunks.limit(0), vectors=self.vectors.limit(0))

    def chunk_count(self) -> int:
        return self.chunks.count()

    def retrieve(self, questions: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank, doc_id, text, start_offset) of the k best passages; questions: (query_id, question)."""
        asked = questions.select("query_id", self.embedder.column(F.col("question")).alias("embedding"))
        return V.top_k(asked, self.vectors, k, min_score).join(self.chunks, "vec_id")

    def rerank(self, results: DataFrame, weight: float = 0.7) -> DataFrame:
        """retrieve()'s rows in an order that weighs closeness to the question against closeness among themselves."""
        ordered = V.rerank_mmr(results.select("query_id", "vec_id", "score", "rank").join(self.vectors, "vec_id"), weight)
        return ordered.join(self.chunks, "vec_id")

    def answer(self, questions: DataFrame, results: DataFrame) -> DataFrame:
        """(query_id, answer, sources, n_sources, provider), one row per question, from retrieve()'s rows."""
        found = V.sources(results, self.budget)
        rows = questions.join(found, "query_id", "left")
        told = self.generator.column(F.col("question"), F.col("sources"))
        none = F.array().cast(found.schema["sources"].dataType)
        return rows.select("query_id", told.alias("answer"), F.coalesce("sources", none).alias("sources"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), F.lit(self.generator.name).alias("provider"))

    def ask(self, questions: DataFrame, k: int) -> DataFrame:
        return self.answer(questions, self.retrieve(questions, k))

    def ask_with_retrieval(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """ask(), and the passages that retrieval found."""
        found = self.retrieve(questions, k)
        return self.answer(questions, found), found


_CHUNK = "text string, index int, start_offset int, token_estimate long"


class _SentenceChunks:
    def eval(self, text: str, max_tokens: int):
        yield from _sentence_chunks(text or "", max_tokens)


class _RecursiveChunks:
    def eval(self, text: str, separators: list, max_tokens: int):
        yield from _recursive_chunks(text or "", tuple(separators), max_tokens)


class _Entities:
    def eval(self, text: str):
        data = text or ""
        for start, end, kind in find_entities(data):
            place = len(data[:start].encode())
            yield KINDS[kind], data[start:end], place, place + len(data[start:end].encode())


def register(spark: SparkSession, prefix: str = "doc_") -> None:
    """SQL names: table functions <prefix>sentence_chunks, <prefix>recursive_chunks, <prefix>entities; functions <prefix>parse, <prefix>tables."""
    spark.udtf.register(f"{prefix}entities", F.udtf(_Entities, returnType="entity_type string, value string, start int, end int"))
    spark.udtf.register(f"{prefix}sentence_chunks", F.udtf(_SentenceChunks, returnType=_CHUNK))
    spark.udtf.register(f"{prefix}recursive_chunks", F.udtf(_RecursiveChunks, returnType=_CHUNK))
    spark.udf.register(f"{prefix}parse", parsed)
    spark.udf.register(f"{prefix}tables", tables)
