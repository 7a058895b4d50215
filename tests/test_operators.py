"""Small cases of the document operators."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.entities import entities
from docloom.functions.fields import data_rows, extracted, field_value, find_tables, header, key_values, row_count, tables
from docloom.operators import chunking as H
from docloom.operators import vectors as V
from docloom.operators.governance import rate_limit
from docloom.operators.compression import compressed, compressed_document
from docloom.operators.reduce import reduce_documents, reduce_levels
from docloom.operators.textrank import LEVELS, Options, rank, reduce_text, split, terms
from docloom.sources.detect import detect_format, detect_text_format
from docloom.sources.parse import docx, epub, html, inline, markdown, parse, plain
from docloom.streaming.events import last_result, progress_events, rate_limit_stream

INVOICE = "Invoice #INV-2024-001\nDate: 2024-03-15\nTotal: $1,250.00\nEmail: billing@acme.com"
STORY = "# Overview\n\nSpark runs queries on many machines. A plan is a tree of operators. Spark optimizes the plan of a query. Operators run on partitions of data. The weather was nice."


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


T = lambda: F.col("text")


@pytest.mark.parametrize("content,kind", [(b"%PDF-1.7", "pdf"), (b"<!DOCTYPE html><p>", "html"), (b"# Title\n", "markdown"), (b"Just prose.", "plaintext"), (b"", "unknown"), (b" \n", "plaintext"), (b"## x", "plaintext"), (b"#1", "markdown"), (b"PK\x03\x04....word/", "docx"), (b"PK\x03\x04mimetypeapplication/epub+zip", "epub"), (b"\xff\xfe", "plaintext"), ("é" * 3000).encode() and (("<a" + "é" * 3000).encode(), "plaintext")])
def test_detect(spark, content, kind):
    assert spark.createDataFrame([(bytearray(content),)], "content binary").select(detect_format(F.col("content")).alias("x")).first()["x"] == kind


def test_entities(spark):
    e = one(spark, entities(T()), INVOICE)
    kinds = {(x["entity_type"], x["value"]) for x in e}
    assert {("email", "billing@acme.com"), ("date", "2024-03-15"), ("money", "$1,250.00")} <= kinds
    data = INVOICE.encode()
    assert all(data[x["start"] : x["end"]].decode() == x["value"] for x in e)
    assert all(a["end"] <= b["start"] for a, b in zip(e, e[1:], strict=False))
    assert one(spark, entities(T()), None) == []
    assert ("money", "$125") in {(x["entity_type"], x["value"]) for x in one(spark, entities(T()), "It cost $1250.00 then")}
    accents = "é " * 5 + "mail a@b.co"
    assert one(spark, entities(T()), accents)[0]["start"] == accents.encode().index(b"a@b")


def test_fields(spark):
    f = one(spark, key_values(T()), "Name: Alice\nsub-total    $5\nThis is a sentence. It has: three. dots. in. it.\nno field\nfoo_bar: x")
    assert [(x["key"], x["value"], x["confidence"]) for x in f] == [("Name", "Alice", 0.9), ("Sub-Total", "$5", 0.75), ("Foo_Bar", "x", 0.9)]
    assert one(spark, field_value(key_values(T()), "NAME"), "name: A\nName: B") == "A"
    x = one(spark, extracted(T(), with_tables=False), INVOICE)
    assert x["field_count"] == len(x["key_values"]) + len(x["entities"]) and x["tables"] == []


def test_tables():
    assert find_tables("Name  Age  City\nAnn  30  Rome\nBob  31  Oslo")[0]["has_header"]
    t = find_tables("intro\n| a | b |\n|---|---|\n| 1 | 2 |\nend")[0]
    assert t["rows"] == [["a", "b"], ["1", "2"]] and t["start_line"] == 2
    assert len(find_tables("a\tb\tc\n1\t\t3\n4\t5\t6")[0]["rows"]) == 3
    assert find_tables("only one line of prose") == []


def test_fnv(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for c in b:
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h

    for word in ("", "a", "straße", "naïve🙂", "x" * 99):
        got = one(spark, X.fnv1a(T()), word)
        assert got["hi"] * 2**32 + got["lo"] == fnv(word.encode())


def test_chunks(spark):
    text = "abcdefghij"
    c = one(spark, H.fixed(T(), 4, 2), text)
    assert [x["text"] for x in c] == ["abcd", "cdef", "efgh", "ghij"]
    assert one(spark, H.fixed(T(), 0, 0), text) == [] and one(spark, H.fixed(T(), 4, 4), "") == []
    p = one(spark, H.paragraphs(T()), "é one\n\n\n\n two")
    assert [(x["text"], x["index"], x["start_offset"]) for x in p] == [("é one", 0, 0), ("two", 2, 10)]
    story = "One two three. Four five six! Seven eight? Nine."
    s = one(spark, H.sentence_chunks(T(), 8), story)
    assert all(x["token_estimate"] <= 10 for x in s) and " ".join(x["text"] for x in s).split() == story.split()
    r = one(spark, H.recursive_chunks(T(), (". ",), 5), "A b c. D e f. G h i. J k l. M n o.")
    assert [x["index"] for x in r] == list(range(len(r))) and len(r) == 5
    assert all(story.encode()[x["start_offset"] :].decode().startswith(x["text"].split(" ")[0]) for x in s)


@pytest.mark.parametrize("text,want", [
    ("Dr. Smith went. He left! ok? Yes.", ["Dr. ", "Smith went. ", "He left! ", "ok? ", "Yes."]), ("3.4 is one. U.S.A. now. e.g. this", ["3.4 is one. ", "U.S.A. now. e.g. this"]),
    ('He said "Go." Then (left.) Nothing. \n\nNew', ['He said "Go." ', "Then (left.) ", "Nothing. \n", "New"]), ("Wait... what? No... Yes", ["Wait... what? ", "No... ", "Yes"]),
    ("end.\r\nnext", ["end.\r\n", "next"]), ("!!! ??", []), ("x. 123 abc. 123 Abc", ["x. 123 abc. ", "123 Abc"]), ("", []), ("One.\u0301 Two", ["One.\u0301 ", "Two"]),
])
def test_sentence_boundaries(text, want):
    assert [text[a:b] for a, b in H.sentence_spans(text)] == want


def test_rank_matches_dense():
    r = random.Random(1)
    bags = [[r.choice("abcdefgh") for _ in range(r.randint(0, 6))] for _ in range(30)]
    n, words = len(bags), sorted({w for b in bags for w in b})
    x = np.array([[b.count(w) for w in words] for b in bags], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    m = x @ x.T
    np.fill_diagonal(m, 0)
    sums = m.sum(1, keepdims=True)
    m = np.divide(m, sums, out=np.zeros_like(m), where=sums > 1e-9)
    s = np.full(n, 1 / n)
    for _ in range(60):
        s = 0.15 / n + 0.85 * (m.T @ s)
    assert np.allclose(rank(bags), s, atol=1e-12)


def test_reduce():
    out = reduce_text(STORY, Options(level="aggressive"))
    assert out["title"] == "Overview" and out["summary"] in STORY.replace("# ", "") and out["original_sentences"] == len(split(STORY))
    light = reduce_text(STORY, Options(level="light"))
    assert out["reduction_percent"] >= light["reduction_percent"]
    assert reduce_text("", Options())["summary"] == "" and terms("The running dogs") == ["runn", "dog"]
    assert rank([["a"], ["b"]], "tfidf").shape == (2,)


def test_compress(spark):
    got = one(spark, compressed(T(), 0.5), "Basically, cats sleep a lot. In order to eat, cats hunt mice. Birds fly south in winter. Cats and birds.")
    assert "asically" not in got and 0 < len(got.split()) <= 10


def test_parsers():
    assert plain("first\n\nsecond")["title"] == "first"
    m = markdown("# T\n\nSome *text*\nmore.\n\n## S\n\n- a\n- [x] b\n\n```py\nx = 1\n```\n\n> q\n")
    kinds = [b["kind"] for s in m["sections"] for b in s["blocks"]]
    assert m["title"] == "T" and kinds == ["heading", "paragraph", "heading", "list", "code", "quote"] and m["sections"][1]["heading"] == "S"
    h = html("<html><head><title>Page</title></head><body><h1>H</h1><p>one<p>two &amp; x<ul><li>a<li>b</ul><pre> k\n</pre></body>")
    assert h["title"] == "Page" and [b["kind"] for b in h["sections"][0]["blocks"]] == ["heading", "paragraph", "paragraph", "list", "code"]
    assert html("<div>loose</div>")["sections"][0]["blocks"][0]["text"] == "loose"
    assert parse("pdf", b"%PDF")["error"] and parse("docx", b"PKbroken")["error"] and parse("html", b"")["error"]


MARKDOWN = """Title here
===

Para *one* with `code *x*` and [link](http://a.b "t")
hard break, <b>bold</b> &amp; \\*esc\\*

***

- a
- b

  second part of b
    - nested 1
- [x] done

> quote *a*
lazy
>
> more

    indented code
      deeper

<div>
ignored <p>
</div>

<https://auto.link> and [ref][r] and ![alt](i.png) ~~gone~~

[r]: http://x.y

a | b
--- | ---
1 | 2

Part
---
snake_case and __strong__ 2 * 3
"""


def test_markdown_blocks():
    m = markdown(MARKDOWN)
    got = [(b["kind"], b["text"] or b["items"]) for s in m["sections"] for b in s["blocks"]]
    assert got == [
        ("heading", "Title here"), ("paragraph", "Para one with code *x* and link hard break, bold & *esc*"), ("list", ["a", "b second part of b", "nested 1", "done"]), ("quote", "quote a lazy more"),
        ("code", "indented code\n  deeper"), ("paragraph", "https://auto.link and ref and alt gone"), ("plain", "a | b\n--- | ---\n1 | 2"), ("heading", "Part"), ("paragraph", "snake_case and strong 2 * 3"),
    ]
    assert m["title"] == "Title here" and [s["heading"] for s in m["sections"]] == [None, "Part"]
    assert markdown("---\n")["sections"][0]["blocks"][0]["kind"] == "paragraph" and markdown("1. a\n\n2. b\n")["sections"][0]["blocks"][0]["items"] == ["a", "b"]


@pytest.mark.parametrize("text,want", [("a*** b*** c",) * 2, ("***both***", "both"), ("**a *b* c**", "a b c"), ("*a **b***", "a b"), ("x_y_z _k_", "x_y_z k"), ("~~s~~ ~t~", "s ~t~"), ("**open only",) * 2, ("a `**x**` **b**", "a **x** b"), ("\\*\\*x**y**", "**xy"), ("&lt;b&gt; <i>k</i> a<b", "<b> k a<b")])
def test_inline_markdown(text, want):
    assert inline(text) == want


def test_markdown_takes_time_in_proportion():
    import time

    began = time.process_time()
    for bad in ("*" * 50_000, "_a" * 50_000, "[" * 50_000, "`" * 50_000 + "a", "> " * 5000 + "x", "- " * 5000 + "x", "<" * 50_000, "**a " * 25_000, "(*" * 25_000):
        assert markdown(bad)["sections"]
    assert time.process_time() - began < 10


def test_docx_and_epub():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t><w:tab/><w:t>more</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    d = docx(data.getvalue())
    assert d["title"] == "Head" and d["sections"][0]["blocks"][1]["text"] == "Text\tmore"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="x" xmlns:dc="y"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<p>Hello there</p>")
    e = epub(data.getvalue())
    assert e["title"] == "Book" and e["sections"][0]["blocks"][0]["text"] == "Hello there"


def made_pdf(contents, fonts, compress=True, packed=False):
    """A PDF of one page for each of contents."""
    import zlib

    n = len(contents)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)) + b"] /Count %d /Resources << /Font << " % n + fonts + b" >> >> >>"}
    streams = {}
    for i, c in enumerate(contents):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body = zlib.compress(c) if compress else c
        streams[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" if compress else b"") + body + b"\nendstream"
    cmap = b"2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    streams[5] = b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"
    if packed:
        parts, offsets = [], []
        for k, o in objects.items():
            offsets.append(b"%d %d" % (k, sum(len(p) + 1 for p in parts)))
            parts.append(o)
        head = b" ".join(offsets) + b" "
        inner = zlib.compress(head + b" ".join(parts))
        streams[4] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objects), len(head), len(inner)) + inner + b"\nendstream"
        objects = {}
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in sorted({**objects, **streams}.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_pdf(compress, packed):
    fonts = b"/F1 << /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /fi /uni20AC] >> >> /F2 << /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"
    first = rb"BT /F1 12 Tf 72 700 Td (First \(line\) \351) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ 0 -40 Td (New paragraph) Tj T* ET"
    second = b"BT /F2 10 Tf 1 0 0 1 72 700 Tm <000100020010> Tj /F1 10 Tf 1 0 0 1 100 700 Tm (\\001x \\002) Tj ET BI /W 1 ID \x00(\xff EI"
    d = parse("pdf", made_pdf([first, second], fonts, compress, packed))
    assert [b["text"] for b in d["sections"][0]["blocks"]] == ["First (line) é\nsecond line", "New paragraph", "Aéa fix €"] and d["title"] == "First (line) é" and d["error"] is None


def test_broken_pdf():
    whole = made_pdf([b"BT /F1 12 Tf (text) Tj ET"], b"/F1 << /Type /Font >>")
    assert parse("pdf", whole)["error"] is None
    r = random.Random(1)
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(r.randint(1, 8)):
            bad[r.randrange(9, len(bad))] = r.randrange(256)
        got = parse("pdf", bytes(bad[: r.randint(9, len(bad))]))
        assert got["error"] or got["sections"]
    assert "encrypted" in parse("pdf", whole + b"<< /Encrypt 9 0 R >>")["error"] and "no text" in parse("pdf", b"%PDF-1.7")["error"]


def test_pipeline_of_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(STORY.encode())), (2, bytearray(b"%PDF-1.4")), (3, None)], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in reduce_documents(df, kind="markdown").collect()}
    assert got[1]["format"] == "markdown" and got[1]["title"] == "Overview" and got[1]["error"] is None
    assert got[2]["error"] and got[3]["error"]
    assert {r["format"] for r in reduce_documents(df, hint="txt").collect()} == {"plaintext"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, "dogs and cats"), (2, "stock market"), (3, None)], "vec_id long, text string")
    a = {r["vec_id"]: r["embedding"] for r in V.embed_rows(df, ["vec_id"]).collect()}
    assert not any(a[3]) and abs(np.linalg.norm(a[1]) - 1) < 1e-6
    # beside the same hash in Column expressions
    h = df.select("vec_id", F.explode(X.embed_terms(T())).alias("w")).select("vec_id", X.fnv1a(F.col("w")).alias("h")).collect()
    for i in (1, 2):
        sums = np.zeros(256)
        for r in h:
            if r["vec_id"] == i:
                sums[(r["h"]["hi"] * 2**32 + r["h"]["lo"]) % 256] += 1 - 2 * (r["h"]["hi"] & 1)
        assert np.allclose(a[i], sums / np.linalg.norm(sums))
    vectors = V.embed_rows(df, ["vec_id"])
    asked = V.embed_rows(spark.createDataFrame([(7, "cats and dogs")], "query_id long, text string"), ["query_id"])
    top = V.top_k(asked, vectors, 2).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["vec_id"] == 1 and abs(top[0]["score"] - 1) < 1e-6
    again = V.rerank_mmr(V.top_k(asked, vectors, 3).join(vectors, "vec_id")).collect()
    assert sorted(r["vec_id"] for r in again) == [1, 2, 3]
    passages = spark.createDataFrame([(7, 1, "0123456789"), (7, 2, "0123456789ab")], "query_id long, rank int, text string")
    assert V.context(passages, 20).first()["context"] == "[1] 0123456789\n"


def test_top_k_in_blocks(spark, monkeypatch):
    """Ties, vectors that aren't comparable, more queries than a block holds, and several tasks and batches."""
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 5)).round(1)
    x[50:90] = x[10]
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 5), (903, [None] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(99, None)], "query_id long, embedding array<double>")
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    score = np.hstack([u[:40] @ u.T, np.zeros((40, 4))])
    ids = np.array([*range(200), 900, 901, 902, 903])
    want = {(q, k + 1): int(ids[i]) for q in range(40) for k, i in enumerate(sorted(range(204), key=lambda i: (-round(score[q, i], 12), ids[i]))[:45])}
    for block, product in ((10_000, 4_000_000), (9, 60)):
        monkeypatch.setattr(V, "BLOCK_QUERIES", block)
        monkeypatch.setattr(V, "PRODUCT", product)
        assert {(t["query_id"], t["rank"]): t["vec_id"] for t in V.top_k(asked, vectors, 45).collect()} == want
    assert V.top_k(asked.limit(0), vectors, 3).count() == 0
    assert V.top_k(asked, vectors, 3, 0.5).filter("score < 0.5").count() == 0


def test_levels_share_a_parse(spark):
    df = spark.createDataFrame([(1, bytearray((STORY + "\n\n```\nqueries code machines code\n```\n").encode())), (2, None)], "doc_id long, content binary")
    rows = {(r["doc_id"], r["level"]): r for r in reduce_levels(df, [Options(level=x) for x in LEVELS]).collect()}
    assert len(rows) == 6 and rows[2, "light"]["error"]
    for level in LEVELS:
        one = [r for r in reduce_documents(df, Options(level=level)).collect() if r["doc_id"] == 1][0]
        assert one["summary"] == rows[1, level]["summary"] and "code" not in one["summary"]
    assert len(rows[1, "aggressive"]["summary"]) <= len(rows[1, "light"]["summary"])


def test_compressed_document(spark):
    from docloom.sources.parse import parsed

    text = "# Basically a title\n\nBasically, cats sleep a lot. Cats hunt mice. Birds fly south in winter. Cats and birds.\n\n```\nactually code\n```\n\n- literally an item\n"
    doc = spark.createDataFrame([(text,)], "text string").select(compressed_document(parsed(F.lit("markdown"), F.encode("text", "UTF-8")), 0.5).alias("d")).first()["d"]
    kinds = {b["kind"]: b["text"] or b["items"] for s in doc["sections"] for b in s["blocks"]}
    assert kinds["heading"] == "Basically a title" and kinds["code"] == "actually code" and kinds["list"] == ["literally an item"]
    assert "asically" not in kinds["paragraph"] and 0 < len(kinds["paragraph"].split()) <= 10


def test_table_parts(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n1  2\n3  4"
    t = spark.createDataFrame([(text,)], "text string").select(F.explode(tables(T())).alias("t"))
    got = t.select(header(F.col("t")).alias("h"), data_rows(F.col("t")).alias("d"), row_count(F.col("t")).alias("n")).collect()
    assert [(r["h"], r["d"], r["n"]) for r in got] == [(["a", "b"], [["1", "2"], ["3", "4"]], 3), (None, [["1", "2"], ["3", "4"]], 2)]


def test_events_and_limits(spark, tmp_path):
    docs = spark.createDataFrame([(1, bytearray(STORY.encode())), (2, bytearray(b"%PDF-1")), (3, None)], "doc_id long, content binary")
    e = progress_events(docs)
    assert [r["phase"] for r in e.filter("doc_id = 1").orderBy("seq").collect()] == ["started", "detected", "parsed", "summarized", "done"]
    assert [r["phase"] for r in e.filter("doc_id = 2").orderBy("seq").collect()] == ["started", "detected", "error"]
    ended = {r["doc_id"]: r for r in last_result(e).collect()}
    whole = [r for r in reduce_documents(docs).collect() if r["doc_id"] == 1][0]
    assert ended[1]["result"]["summary"] == whole["summary"] and ended[1]["result"]["metrics"]["original_words"] == whole["metrics"]["original_words"] and ended[1]["error"] is None
    assert ended[2]["result"] is None and "pdf" in ended[2]["error"] and ended[3]["error"]
    docs.write.parquet(str(tmp_path / "docs"))
    stream = progress_events(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")))
    q = stream.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("told").collect())) == sorted(map(str, e.collect()))
    r = spark.sql("SELECT 'al' AS actor, id AS request_id, timestamp_seconds(1000 + id) AS ts FROM range(3)")
    assert [x["allowed"] for x in rate_limit(r, "actor", "ts", "request_id", 60, 2).orderBy("request_id").collect()] == [True, True, False]
    r.write.parquet(str(tmp_path / "in"))
    q = rate_limit_stream(spark.readStream.schema(r.schema).parquet(str(tmp_path / "in")), 60, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(x["allowed"] for x in spark.sql("SELECT * FROM limited").collect()) == [False, True, True]


def test_text_formats_of_null(spark):
    assert one(spark, detect_text_format(T()), None) == "unknown"
