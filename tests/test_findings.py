"""Queries beside their SQL, and operators beside plain forms, where a review found them apart."""

import datetime as dt

import duckdb

from docloom.plans.oracles import ORACLES
from docloom.plans.queries import Q


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of (schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = Q[name](spark, str(folder))
    columns = sorted(df.columns)
    told = lambda rows: sorted(map(repr, map(tuple, rows)))
    return told(df.select(columns).collect()), told(con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def test_requests_of_the_half_second_before_a_window(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 0, 59, 59, us) for us in (499_999, 500_000, 500_001, 700_000)] + [dt.datetime(2024, 1, 1, 1, 0, 0, 100)]
    rows = [(i, t, 7) for i, t in enumerate(at)]
    ours, sql = both(spark, tmp_path, "q_rate_limit", events=("event_id long, ts timestamp, user_id long", rows))
    assert ours == sql


def test_references_without_a_semicolon(spark, tmp_path):
    html = "<html><title>a&amp;b &amp</title><nav><ul><li>x&quot y&quot;</li></ul></nav><article><h1>c &amp</h1><p>d&copy e&copy; &middot &x</article>"
    ours, sql = both(spark, tmp_path, "q_parse_html", pages=("page_id long, url string, html string", [(1, "u", html)]))
    assert ours == sql


TEXT = "Rivers carry water to the sea. Water from rivers feeds the sea! Ships cross the wide sea. Old maps show rivers? Nothing here is shared."


def test_workers_take_few_rows_at_a_time(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from docloom.functions.parts import BYTES, ROWS, in_parts

    size = in_parts(lambda texts: [len(texts)] * len(texts), T.IntegerType())
    rows = spark.range(3000, numPartitions=1).select(size(F.when(F.col("id") % 7 > 0, F.lit("x"))).alias("n"))
    assert rows.count() == 3000 and rows.agg(F.max("n")).first()[0] == ROWS
    long_ = spark.range(9, numPartitions=1).select(size(F.lit("x" * (BYTES // 2))).alias("n"))
    assert long_.agg(F.max("n")).first()[0] == 2


def test_ranks_of_many_texts_are_those_of_each(spark):
    import numpy as np

    from docloom.operators.textrank import rank, rank_all, split, terms

    texts = ["", "One.", TEXT, " ".join(f"Word{i % 13} stands by word{i % 7} here." for i in range(900)), TEXT[::-1], *[TEXT[i:] for i in range(60)]] * 3
    bags = [[terms(s) for s in split(t)] for t in texts]
    for weighting in ("tf", "tfidf"):
        assert all(np.array_equal(a, rank(b, weighting)) for a, b in zip(rank_all(bags, weighting), bags, strict=True))


def test_keywords_need_no_ranks(spark, monkeypatch):
    from docloom.operators import textrank

    monkeypatch.setattr(textrank, "ROUNDS", None)  # a rank fails
    assert textrank.frequent([textrank.terms(s) for s in textrank.split(TEXT)], 3) == ["river", "sea", "wat"]
    plan = Q["q_keywords"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "reduction_percent" not in plan


def test_term_counts_stay_where_texts_are_read(spark, tmp_path):
    rows = [(i, TEXT, "en", "s", len(TEXT)) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ours, sql = both(spark, tmp_path / "one", "q_term_freq", documents=(schema, rows))
    assert ours == sql
    plan = Q["q_term_freq"](spark, str(tmp_path / "one"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    odd = [(1, "# A b\n\n## Words *words* ends.\x0bNext `word`.", "en", "s", 1), (1, TEXT, "en", "s", 1), (2, None, "en", "s", 0), (None, "left alone. Again alone.", "en", "s", 1), (None, "left", "en", "s", 1)]
    d = str(tmp_path / "odd")
    spark.createDataFrame(odd, schema).write.parquet(f"{d}/documents.parquet")
    found = {(r.doc_id, r.idx, r.term): r.tf for r in Q["q_term_freq"](spark, d).collect()}
    assert found[None, 0, "left"] == 2 and found[1, 0, "word"] == 2 and len(found) == Q["q_term_freq"](spark, d).count()


def test_nearest_vectors_over_many_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from docloom.operators import vectors as V

    monkeypatch.setattr(V, "PART", 7)
    r = np.random.default_rng(5)
    x = r.integers(-2, 3, (400, 4)).astype(np.float32)  # many ties and some zero vectors
    q = r.integers(-2, 3, (9, 4)).astype(np.float64)
    unit = np.divide(q, n := np.linalg.norm(q, axis=1, keepdims=True), out=np.zeros_like(q), where=n > 0)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 100)[::-1]), pa.array(list(x[a : a + 100][::-1]), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for a in range(0, 400, 100)]
    found = next(V._nearest(np.arange(9), unit, 5)(batches)).to_pydict()
    y = x.astype(np.float64)
    y = np.divide(y, n := np.linalg.norm(y, axis=1, keepdims=True), out=np.zeros_like(y), where=n > 0)
    for i in range(9):
        best = np.lexsort((np.arange(400), -np.round(unit[i] @ y.T, 12)))[:5]
        assert [v for k, v in zip(found["query_id"], found["vec_id"], strict=True) if k == i] == best.tolist()


def test_markdown_is_parsed_a_few_documents_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from docloom.sources import parse

    run = parse._parsed(parse.parse).func
    n = 1000
    made = list(run(iter([(pa.array(["markdown"] * n), pa.array([b"# a\n\nb"] * n))])))
    assert sum(map(len, made)) == n and max(map(len, made)) <= 256 and made[-1][-1].as_py()["title"] == "a"


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = ("page_id long, url string, html string", [(1, "u", ""), (2, "u", None), (3, "u", "<html></html>")])


def test_formats_of_empty_and_null_texts(spark, tmp_path):
    rows = [(1, "", "en", "s", 0), (2, "Words. More.", "en", "s", 12), (3, " ", "en", "s", 1), (4, None, "en", "s", 0)]
    ours, sql = both(spark, tmp_path, "q_detect_bytes", documents=(DOCUMENTS, rows), pages=PAGES)
    known = lambda rows: [r for r in rows if " 4, 'markdown'" not in r]  # noqa: E731  # SQL takes each row's made Markdown for granted
    assert known(ours) == known(sql)


def test_errors_of_empty_texts(spark, tmp_path):
    rows = [(1, "", "en", "s", 0), (2, "Words. More.", "en", "s", 12), (3, " ", "en", "s", 1)]
    ours, sql = both(spark, tmp_path, "q_parse_errors", documents=(DOCUMENTS, rows), pages=PAGES)
    assert ours == sql
