"""Page differencing beside plain loops: alignment, neighbours over the whole table, and that it runs on every page."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import page_text as P

DATA = "/root/testdata/sf0.001"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 6])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(P, "TABLE_BITS", bits)
    r = random.Random(1)
    for _ in range(3000):
        a, b = (r.choices("abcde" + x, k=r.randint(0, 14)) for x in "fg")
        found = sorted(P.common(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found), (a, b, found)


def test_long_pages_align_in_little_memory():
    import tracemalloc

    r = random.Random(2)
    a, b = ([str(r.randint(0, 30_000)) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    found = P.common(a, b)
    assert tracemalloc.get_traced_memory()[1] < 80_000_000 and len(found) > 100
    tracemalloc.stop()


def plain_texts(rows):
    """The text of each page by loops over the sorted table: runs of equal pages of a host, and their nearest neighbours."""

    def place(row):
        url = row["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        h = 42 if row["html"] is None else xxhash.xxh64_intdigest(row["html"].encode(), seed=42)
        return host.lower(), path, row["page_id"] is not None, row["page_id"] or 0, h - (h >> 63 << 64)

    ordered = sorted(((place(r), P.lines(r["html"] or ""), r) for r in rows), key=lambda x: x[0])
    runs = []
    for key, found, row in ordered:
        if not runs or runs[-1][0] != key[0] or runs[-1][1] != found:
            runs.append((key[0], found, []))
        runs[-1][2].append(row)
    out, compared = [], 0
    for i, (host, found, own) in enumerate(runs):
        at = lambda k: [runs[k][1]] if 0 <= k < len(runs) and runs[k][0] == host else []
        near, far = at(i - 1) + at(i + 1), (at(i - 2) if at(i - 1) else []) + (at(i + 2) if at(i + 1) else [])
        compared += bool(near) * len(own)
        out += [(r["page_id"], r["url"], P.main_text(found, near, far)) for r in own]
    return out, compared


@pytest.mark.parametrize("size", [1000, 7])
def test_whole_table_beside_plain_loops(spark, monkeypatch, size):
    monkeypatch.setattr(P, "RANGE", size)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    # many hosts have one page only: let pages share hosts, repeat some, and give some no article
    more = pages.selectExpr("page_id", "concat('http://', substr(split(url, '://')[1], 1, 3), '.com/', page_id % 7, '/', page_id) AS url", "if(page_id % 3 = 0, replace(replace(html, '<article>', ''), '</article>', ''), html) AS html")
    every = pages.union(more).union(more.limit(5))
    want, compared = plain_texts([r.asDict() for r in every.collect()])
    got = sorted((r["page_id"], r["url"], r["text"]) for r in P.page_text(every.repartition(3)).collect())
    assert got == sorted(want) and compared > len(want) / 3


def test_a_page_that_most_rows_repeat(spark, monkeypatch):
    """Its rows are dealt over many ranges, and each is compared with the distinct pages around it."""
    monkeypatch.setattr(P, "RANGE", 20)
    page = lambda x: f"<body><p>The name of this site and what it is all about<p>Own words of page {x} alone<p>All rights of these pages reserved"
    rows = [(i, f"http://h.com/{i:03}", page(f"{i} {'xyz'[i % 3]}")) for i in range(40)] + [(20, "http://h.com/020", page("20 z"))] * 400 + [(20, "http://h.com/020", page("other"))] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df = P.page_text(pages)
    got = sorted((r["page_id"], r["url"], r["text"]) for r in df.collect())
    want, _ = plain_texts([dict(zip(("page_id", "url", "html"), r)) for r in rows])
    assert got == sorted(want)
    assert max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) < 200


def test_differencing_runs_on_the_registered_table(spark):
    """Pages with a neighbour on their host are aligned, marked article or not, and lines go by alignment alone."""
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    seen = []
    kept = P.kept_lines
    try:
        P.kept_lines = lambda found, near, far=(): seen.append((len(found), len(near), kept(found, near, far))) or seen[-1][2]
        plain_texts(rows)
    finally:
        P.kept_lines = kept
    assert len(seen) == len(rows) and sum(near > 0 for _, near, _ in seen) > 0.5 * len(rows)
    assert sum(n - len(left) for n, near, left in seen if near) > 0


def test_comments_that_are_articles():
    page = '<main><article><p>Text</p></article></main><section class="comments"><article class="comment-body">First!</article></section>'
    assert P.main_text(P.lines(page), []) == "Text"
    assert P.main_text(P.lines('<article class="comment">Only this</article>'), []) == "Only this"
    assert P.main_text(P.lines('<article class="post">A</article><article class="commentary-free">B</article>'), []) == "A B"
