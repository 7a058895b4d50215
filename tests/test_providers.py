"""The user's own parts in place of the library's."""

import pytest
from pyspark.sql import functions as F

from docloom import api, providers
from docloom.operators import chunking as H
from docloom.operators.governance import limited
from docloom.operators.reduce import reduce_documents
from docloom.sources.parse import block, document


def test_embedder_and_generator(spark):
    docs = spark.createDataFrame([(1, "aaaa a."), (2, "bbbb b.")], "doc_id long, text string")
    own = providers.BatchEmbedder("letters", 3, lambda texts: [[t.count("a"), t.count("b"), 1.0] for t in texts])
    said = providers.BatchGenerator("mine", lambda q, p: f"{q}: {len(p)}")
    assert isinstance(own, providers.EmbeddingProvider) and isinstance(said, providers.Generator)
    rag = api.Rag.ingest(docs, H.Paragraph(), own, said)
    asked = spark.createDataFrame([(5, "bb?")], "query_id long, question string")
    assert rag.retrieve(asked, 1).first()["doc_id"] == 2
    told = rag.ask(asked, 2).first()
    assert told["answer"] == "bb?: 2" and told["provider"] == "mine" and told["sources"][0]["text"] == "bbbb b."
    assert api.Rag.ingest(docs.limit(0), H.Paragraph(), own, said).ask(asked, 2).first()["answer"] == "bb?: 0"
    with pytest.raises(ValueError):
        rag.add(api.Rag.ingest(docs))


def test_parsers_and_abstractive(spark):
    def pdf(data):
        if b"bad" in data:
            raise RuntimeError("no pages")
        return document("Paper", [{"heading": None, "level": 0, "blocks": [block("paragraph", "One sentence that is long enough. Another one is here.")]}])

    docs = spark.createDataFrame([(1, bytearray(b"%PDF-1 x")), (2, bytearray(b"%PDF-1 bad")), (3, bytearray(b"Plain text that stays as it is."))], "doc_id long, content binary")

    class Shout:
        name = "shout"

        def column(self, summary):
            return F.upper(summary)

    got = {r["doc_id"]: r for r in reduce_documents(docs, parsers=providers.Parsers().with_parser("pdf", pdf), abstractive=Shout()).collect()}
    assert got[1]["title"] == "Paper" and got[1]["error"] is None and got[1]["summary"].isupper()
    assert got[2]["error"] == "pdf: no pages" and got[3]["summary"] == "PLAIN TEXT THAT STAYS AS IT IS."
    assert isinstance(Shout(), providers.AbstractiveProvider)
    echo = {r["doc_id"]: r["summary"] for r in reduce_documents(docs, abstractive=providers.LocalEcho()).collect()}
    assert echo[3] == "Plain text that stays as it is."


def test_strategies_and_tokens(spark):
    text = "One two three. Four five six.\n\nSeven eight nine. Ten."
    df = spark.createDataFrame([(text,)], "t string")
    for strategy, column in ((H.Fixed(20, 5), H.fixed(F.col("t"), 20, 5)), (H.Sentence(8), H.sentence_chunks(F.col("t"), 8)), (H.Paragraph(), H.paragraphs(F.col("t"))), (H.Recursive((". ",), 5), H.recursive_chunks(F.col("t"), (". ",), 5)), (H.Semantic(8), H.semantic_chunks(F.col("t"), 8))):
        r = df.select(H.chunk(F.col("t"), strategy).alias("a"), column.alias("b")).first()
        assert r["a"] == r["b"] and r["a"]
    assert df.select(H.chunk(F.col("t")).alias("a")).first()["a"][0]["start_offset"] == 0
    counter = providers.HeuristicTokens()
    assert isinstance(counter, providers.TokenCounter) and df.select(counter.column(F.col("t")).alias("n")).first()["n"] == counter.count(text) == 13


def test_governance(spark):
    df = spark.createDataFrame([(b"secret",)], "b binary")
    null, aes = providers.NullEncryptor(), providers.AesEncryptor(F.lit(b"0123456789abcdef"))
    for e in (null, aes):
        assert isinstance(e, providers.Encryptor) and bytes(df.select(e.decrypt(e.encrypt(F.col("b"))).alias("x")).first()["x"]) == b"secret"
    assert bytes(df.select(aes.encrypt(F.col("b")).alias("x")).first()["x"]) != b"secret"
    r = spark.sql("SELECT 'al' AS actor, id, timestamp_seconds(1000 + id) AS ts FROM range(3)")
    assert [x["allowed"] for x in limited(r, providers.FixedWindow(60, 2), "actor", "ts", "id").orderBy("id").collect()] == [True, True, False]
    assert limited(r, providers.Unlimited(), "actor", "ts", "id").filter("allowed").count() == 3
    seen = df.select(providers.LocalVision().column(F.col("b")).alias("x")).first()["x"]
    assert seen["confidence"] == 0 and seen["tables"] == [] and isinstance(providers.LocalVision(), providers.VisionModel)
