"""The library's verbs over files, single documents, questions and SQL."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import api
from docloom.operators.chunking import Fixed

INVOICE = "Invoice: INV-2024001\nDate: 2024-03-15\nTotal: $1,250.00\nEmail: a@example.com\n"


def test_single_documents(spark):
    r = api.reduce(spark, "# Overview\n\nFirst sentence is about cats here. Second sentence is about dogs here. Third one is about cats and dogs.")
    assert r["format"] == "markdown" and r["title"] == "Overview" and r["output"] and r["metrics"]["original_words"] > 0
    assert api.reduce(spark, b"# Not a heading really", hint="txt")["format"] == "plaintext"
    with pytest.raises(ValueError):
        api.reduce(spark, b"%PDF-1.7")
    x = api.extract_text(spark, INVOICE)
    assert {f["key"] for f in x["key_values"]} == {"Invoice", "Date", "Total", "Email"} and x["provider"] == "heuristic"
    assert "email" in {e["entity_type"] for e in x["entities"]}
    assert api.extract(spark, INVOICE, with_entities=False)["result"]["entities"] == []
    assert api.version()


def test_files_and_json(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nOne sentence that is long enough. Another sentence that follows it.")
    (tmp_path / "b.html").write_text("<html><title>T</title><p>Some text is in here.</p></html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    rows = {r["doc_id"].rsplit("/", 1)[1]: r for r in api.reduce_files(spark, f"file://{tmp_path}").collect()}
    assert rows["a.md"]["title"] == "Title" and rows["b.html"]["format"] == "html" and rows["c.pdf"]["error"]
    found = api.to_json(api.extract_documents(api.read_files(spark, f"file://{tmp_path}/b.html"))).first()["json"]
    assert "\n" in found and json.loads(found)["format"] == "html"


def test_questions(spark):
    docs = spark.createDataFrame([(1, "Cats purr softly at night."), (2, "The stock market fell on Monday."), (3, None)], "doc_id long, text string")
    rag = api.Rag.ingest(docs)
    assert rag.chunk_count() == 2
    asked = spark.createDataFrame([(7, "When do cats purr?")], "query_id long, question string")
    best = rag.retrieve(asked, 1).first()
    assert best["doc_id"] == 1 and best["rank"] == 1
    told = rag.ask(asked, 2).first()
    assert told["n_sources"] == 2 and told["answer"].startswith('Based on 2 retrieved passage(s), here is what the document says about "When do cats purr?"') and "[1] Cats purr" in told["answer"]
    small = api.Rag(rag.chunks, rag.vectors, budget=3).ask(asked, 2).first()
    assert small["n_sources"] == 0 and small["answer"].startswith("Based on 0 ")
    empty = api.Rag.ingest(docs.limit(0)).ask(asked, 2).first()
    assert empty["n_sources"] == 0 and empty["answer"].startswith('No relevant passages were found to answer: "When')
    more = rag.add(api.Rag.ingest(spark.createDataFrame([(4, "abcdefghij")], "doc_id long, text string"), Fixed(4, 2)))
    assert more.chunk_count() == 6 and more.clear().chunk_count() == 0
    both, found = rag.ask_with_retrieval(asked, 2)
    sources = both.first()["sources"]
    assert [x["rank"] for x in sources] == [1, 2] and sources[0]["doc_id"] == 1 and found.count() == 2 and empty["sources"] == []
    assert sorted(x["vec_id"] for x in rag.rerank(found).collect()) == sorted(x["vec_id"] for x in found.collect())


def test_sql_names(spark):
    api.register(spark)
    assert spark.sql("SELECT text FROM doc_sentence_chunks('One sentence here. Two sentences here.', 4)").count() == 2
    joined = spark.sql("SELECT d.id, c.text FROM VALUES (1, 'a b. c d') AS d(id, t), LATERAL doc_recursive_chunks(d.t, array('. '), 2) c")
    assert joined.count() == 2
    found = spark.sql("SELECT e.* FROM VALUES ('é a@b.co, 5%') AS d(t), LATERAL doc_entities(d.t) e").collect()
    assert [(r["entity_type"], r["value"], r["start"], r["end"]) for r in found] == [("email", "a@b.co", 3, 9), ("percent", "5%", 11, 13)]
    assert spark.sql("SELECT doc_parse('markdown', CAST('# T\n\nx' AS BINARY)).title AS t").first()["t"] == "T"
    assert spark.createDataFrame([("a\tb\n1\t2\n",)], "t string").select(F.size(F.call_function("doc_tables", "t")).alias("n")).first()["n"] == 1
