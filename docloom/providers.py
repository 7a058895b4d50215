"""What users may put in place of the library's own parts: protocols, and the local parts themselves.

Each provider turns a Column or a batch of values into another; user code enters the plan as an Arrow function, so no
provider needs to know of partitions, and one that keeps state keeps it for a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@runtime_checkable
class EmbeddingProvider(Protocol):
    """Vectors of texts; column() of a text column is array<float> of length dim."""

    name: str
    dim: int

    def column(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashEmbedder:
    dim: int = 256
    name: str = "local-hash"

    def column(self, text: Column) -> Column:
        from docloom.operators.vectors import hash_embed

        return hash_embed(text, self.dim)


@dataclass(frozen=True)
class BatchEmbedder:
    """An embedder from a function of a batch: a list of texts to a list of vectors."""

    name: str
    dim: int
    embed: Callable[[list[str]], Sequence[Sequence[float]]]

    def column(self, text: Column) -> Column:
        embed, dim = self.embed, self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(texts):
            import pandas as pd

            made = [[float(x) for x in v] for v in embed([t or "" for t in texts])]
            if any(len(v) != dim for v in made):
                raise ValueError(f"vectors must have {dim} components")
            return pd.Series(made, index=texts.index, dtype=object)

        return run(text)


@runtime_checkable
class Generator(Protocol):
    """Answers; sources is an array of structs with rank and text, null where nothing was found."""

    name: str

    def column(self, question: Column, sources: Column) -> Column: ...


@dataclass(frozen=True)
class EchoGenerator:
    """The passages under a fixed heading."""

    name: str = "local-echo"

    def column(self, question: Column, sources: Column) -> Column:
        from docloom.operators.vectors import answer

        lines = F.transform(sources, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"], F.lit("\n")))
        return answer(question, F.array_join(lines, ""), F.when(sources.isNotNull(), F.size(sources)))


@dataclass(frozen=True)
class BatchGenerator:
    """A generator from a function of a question and its passages."""

    name: str
    generate: Callable[[str, list[str]], str]

    def column(self, question: Column, sources: Column) -> Column:
        generate = self.generate

        @F.pandas_udf("string")
        def run(questions, passages):
            import pandas as pd

            return pd.Series([generate(q, [] if p is None else list(p)) for q, p in zip(questions, passages, strict=True)], index=questions.index, dtype=object)

        return run(question, F.transform(sources, lambda x: x["text"]))


@runtime_checkable
class TokenCounter(Protocol):
    def column(self, text: Column) -> Column: ...

    def count(self, text: str) -> int: ...


@dataclass(frozen=True)
class HeuristicTokens:
    """1.3 tokens a word, rounded half up."""

    def column(self, text: Column) -> Column:
        from docloom.functions.text import estimate_tokens

        return estimate_tokens(text)

    def count(self, text: str) -> int:
        from docloom.operators.chunking import tokens_of

        return tokens_of(text)


@dataclass(frozen=True)
class Parsers:
    """Parsers by format that stand before the library's own: from bytes to sources.parse.document()."""

    by_format: dict[str, Callable[[bytes], dict]] = field(default_factory=dict)

    def with_parser(self, kind: str, parse: Callable[[bytes], dict]) -> Parsers:
        return Parsers({**self.by_format, kind: parse})


@runtime_checkable
class AbstractiveProvider(Protocol):
    name: str

    def column(self, summary: Column) -> Column: ...


@dataclass(frozen=True)
class LocalEcho:
    """The summary as it is."""

    name: str = "local-echo"

    def column(self, summary: Column) -> Column:
        return summary


@runtime_checkable
class VisionModel(Protocol):
    """Tables, fields and entities of page images."""

    name: str

    def column(self, image: Column) -> Column: ...


@dataclass(frozen=True)
class LocalVision:
    """Finds nothing, with confidence 0: stands where no model is at hand."""

    name: str = "local-vlm"

    def column(self, image: Column) -> Column:
        from docloom.functions.fields import nothing_extracted

        return nothing_extracted(self.name)


@runtime_checkable
class Encryptor(Protocol):
    def encrypt(self, data: Column) -> Column: ...

    def decrypt(self, data: Column) -> Column: ...


@dataclass(frozen=True)
class NullEncryptor:
    """Bytes as they are: not secure."""

    def encrypt(self, data: Column) -> Column:
        return data

    def decrypt(self, data: Column) -> Column:
        return data


@dataclass(frozen=True)
class AesEncryptor:
    """AES-GCM with a key of 16, 24 or 32 bytes that a Column gives, so that a secret store can hold it."""

    key: Column

    def encrypt(self, data: Column) -> Column:
        return F.aes_encrypt(data, self.key)

    def decrypt(self, data: Column) -> Column:
        return F.aes_decrypt(data, self.key)


@runtime_checkable
class SignOn(Protocol):
    """Single sign-on: the actor that a token stands for, null for none. The library has none of its own."""

    def actor(self, token: Column) -> Column: ...


@runtime_checkable
class RateLimiter(Protocol):
    """Whether each request may pass; requests has the named columns."""

    def allowed(self, actor: str, ts: str, order: str) -> Column: ...


@dataclass(frozen=True)
class Unlimited:
    def allowed(self, actor: str, ts: str, order: str) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class FixedWindow:
    """The first `most` requests of an actor in each window since the epoch."""

    seconds: int
    most: int

    def allowed(self, actor: str, ts: str, order: str) -> Column:
        from pyspark.sql import Window

        second = F.unix_timestamp(ts)
        start = second - F.pmod(second, F.lit(self.seconds))
        return F.row_number().over(Window.partitionBy(actor, start).orderBy(ts, order)) <= self.most
