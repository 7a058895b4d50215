"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names and other types, for every operator and stage."""

import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import components as components_module
from docloom.llm import page_text, piece_codec, quality_net, quality_rules, queries, secret_scan, shingle_join, source_mixing, tables, token_counts, url_filter, vector_dedup
from docloom.llm.components import components

BPE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
#: Names that operators use inside.
CLASHING = "__id __text __ids __h1 __n __r row id h h1 h2 k n g rep token tokens block b o e data raw key ids n_ids round_trip score predicted kept host path rule verdict mix_epoch mix_block mix_order own bucket digest component node u v".split()


def norm(d):
    return sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def operators(spark):
    """Each operator as a function from documents to rows."""
    net = quality_net.Net(1)
    return {
        "mixed": lambda d: source_mixing.mixed(d).select("doc_id", "mix_epoch", "mix_block", "mix_order"),
        "score": lambda d: quality_net.score(d, net),
        "shingles": shingle_join.shingle_components,
        "keep_one": lambda d: shingle_join.keep_one(d).select("doc_id", "text"),
        "secrets": secret_scan.secret_scan,
        "redacted": lambda d: secret_scan.redacted(d).select("doc_id", "text"),
        "pieces": lambda d: piece_codec.piece_encode(d, PIECE),
        "rules": quality_rules.quality_rules,
        "keep_good": lambda d: quality_rules.keep_good(d).select("doc_id", "text"),
        "counts": lambda d: token_counts.token_counts(d, BPE),
        "prefixes": lambda d: token_counts.prefix_tables(d, BPE),
        "truncated": lambda d: token_counts.truncated(d, BPE, 5).select("doc_id", "text"),
    }


def documents(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long")


def some_rows():
    word = lambda i: " ".join(f"w{i}x{j}" for j in range(70))
    rows = [(i, word(i), "en", f"s{i % 2}", 9) for i in range(6)] + [(7, None, "en", "s0", 0), (8, "", None, None, None), (9, " \n", "en", "s1", 2)]
    return [*rows, (1, word(1), "en", "s1", 9), (10, word(2) + " end", "en", "s0", 9)]


def test_clashing_names_and_types(spark):
    plain = documents(spark, some_rows())
    more = plain.select("*", *[F.lit(-5).alias(c) for c in CLASHING])
    small = documents(spark, some_rows(), "int")
    for name, run in operators(spark).items():
        want = rows_of(run(plain))
        assert rows_of(run(more)) == want, name
        assert rows_of(run(small)) == want, name
        assert run(plain.limit(0)).count() == 0, name
    for keep in (shingle_join.keep_one, quality_rules.keep_good, secret_scan.redacted):
        out = keep(more)
        assert out.columns == more.columns and set(out.select("__id", "row", "key").collect()) == {(-5, -5, -5)}


def test_stages(spark):
    docs = documents(spark, some_rows())
    clashing = docs.select("*", *[F.lit(3).alias(c) for c in CLASHING if not c.startswith("mix_")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").columns == docs.columns, name
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns and stage(spark, docs.limit(0), "").count() == 0, name
        assert rows_of(out.select(docs.columns)) == rows_of(stage(spark, docs, "")), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), "").count() == 0 and last(spark, clashing, "").count() == docs.count()


def test_very_long_texts(spark):
    """A text of 5 MB beside short ones, and one of as many bytes without a space."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(3000)]
    long = " ".join(r.choices(words, k=900_000))
    docs = documents(spark, [(1, long, "en", "s", 1), (2, "short text", "en", "s", 1), (3, long + " end", "en", "s", 1), (4, "x" * 5_000_000, "en", "t", 1)]).repartition(2)
    got = {name: {r["doc_id"]: r for r in run(docs).drop("ids", "counts").collect()} for name, run in operators(spark).items() if name != "prefixes"}
    assert got["shingles"][3]["component_id"] == 1 and got["shingles"][4]["n_shingles"] == 1 and set(got["keep_one"]) == {1, 2, 4}
    assert got["rules"][1]["n_words"] == 900_000 and got["counts"][1]["n_bytes"] == len(long) and got["counts"][4]["n_tokens"] > 100_000
    assert got["pieces"][1]["round_trip"] and got["pieces"][4]["round_trip"] and got["secrets"][1]["spans"] == "" and 0 <= got["score"][1]["score"] <= 1


def test_long_page(spark):
    html = "<article>" + "".join(f"<p>line {i} of a page that is long" for i in range(30_000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://h.com/a", html), (2, "http://h.com/b", html.replace("line 7 ", "other 7 ")), (2, "http://h.com/b", None), (None, None, "")], "page_id long, url string, html string")
    got = page_text.page_text(pages.select("*", *[F.lit(1).alias(c) for c in CLASHING])).collect()
    assert len(got) == 4 and max(r["n_chars"] for r in got) > 0 and page_text.page_text(pages.limit(0)).count() == 0
    assert url_filter.url_filter(pages.limit(0)).count() == 0 and url_filter.url_filter(pages.select("*", *[F.lit(1).alias(c) for c in CLASHING])).count() == 4


def test_sql_on_odd_rows(spark, tmp_path):
    """The queries beside their SQL on rows that the test tables don't have: nulls, repeats, a source with most rows, secrets."""
    r = random.Random(2)
    bits = ["password", "token=", "api_key: ", '"', "abcdef1", "AKIA" + "A1" * 8, "deadbeef" * 3, " ", "\n", "é", "same words again ", "gh" + "p_" + "a1" * 20, "xoxb-" + "1a-" * 6, "#"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 30))), "en", "big" if i % 3 else f"s{i % 12}", 1) for i in range(300)]
    rows += [(400, None, "en", "big", 0), (401, "", "en", None, 0), (402, None, None, "nothing", 0), (5, "again " * 60, "en", "big", 1), (5, "again " * 60, "en", "big", 1), (403, "a b c d e f g " * 20, "en", "s3", 1)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_source_mixing", "op5_secret_scan", "op8_quality_rules"):
        assert norm(queries.queries()[name](spark, str(tmp_path)).toPandas()) == norm(con.execute(queries.ORACLES[name]).fetchdf()), name
    unique = documents(spark, [x for x in rows if x[0] != 5])
    unique.write.parquet(str(tmp_path / "u" / "documents.parquet"))
    con.execute(f"create or replace view documents as select * from '{tmp_path}/u/documents.parquet/*.parquet'")
    assert norm(queries.queries()["op4_shingle_join"](spark, str(tmp_path / "u")).toPandas()) == norm(con.execute(queries.ORACLES["op4_shingle_join"]).fetchdf())


def test_added_secret_rules():
    """Beside the regular expressions of the standard library."""
    rules = secret_scan.BASE_RULES + secret_scan.ADDED_RULES
    s = secret_scan.scanner(rules)
    plain = {"private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "forge_token": r"gh[pousr]_[A-Za-z0-9]+", "chat_token": r"xox[abprs]-[A-Za-z0-9-]+"}
    least = {"private_key": 1, "forge_token": 40, "chat_token": 20}
    r = random.Random(3)
    bits = ["-----BEGIN ", "PRIVATE KEY-----", "RSA ", "ghp_", "gho_", "ghx_", "xoxb-", "xoxs-", "xo", "a1B2c3D4", "abcdefghijklmnopqrstuvwxyz0123456789", "-", "_", ". ", "é", "\n"]
    for _ in range(3000):
        t = "".join(r.choices(bits, k=r.randint(0, 14)))
        found = [(a, rules[k].kind, b) for a, k, b in s.spans(t) if k >= 3]
        for kind, pattern in plain.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least[kind]]
            got = [(a, b) for a, k, b in found if k == kind]
            if kind == "private_key":  # a span goes on over the key's body
                assert [a for a, _ in got] == [a for a, _ in want][: len(got)] and all(any(a <= c and d <= b for a, b in got) for c, d in want), t
            else:
                assert got == want, t


def test_blocks_and_order_of_a_mix(spark):
    """mix_block, mix_order and the block at the edge beside plain loops over sources with many blocks."""
    import hashlib

    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 30), "en", "a" if r.random() < 0.8 else "bcd"[i % 3], 1) for i in range(900)]
    docs = documents(spark, rows)
    mix = source_mixing.Mix(entropy=0.8, repeats=2.5, block_tokens=40)
    for ranges in (4096, 4):
        source_mixing.RANGES, kept = ranges, source_mixing.RANGES
        try:
            got = sorted(tuple(x) for x in source_mixing.mixed(docs, mix).select("doc_id", "source", "mix_epoch", "mix_block", "mix_order").collect())
        finally:
            source_mixing.RANGES = kept
        digest = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:15], 16)
        size = {i: len(t.split()) for i, t, *_ in rows}
        total = {s: sum(size[i] for i, _, _, t, _ in rows if t == s) for s in "abcd"}
        taken = {s: sum(size[i] for i, t, *_ in got if t == s) for s in "abcd"}
        want = []
        for s in "abcd":
            n = -(-total[s] // 40)
            block = {i: digest(17, i) % n for i, _, _, t, _ in rows if t == s}
            # the goal lies between what was taken and the next document in order
            epochs, goal = divmod(taken[s], total[s])
            order = sorted({*block.values()}, key=lambda b: (digest("17/block", f"s{s}", b, epochs + 1), b))
            left, last = goal, []
            for b in order:
                here = [i for i in block if block[i] == b]
                if sum(size[i] for i in here) <= left:
                    last += here
                    left -= sum(size[i] for i in here)
                    continue
                for i in sorted(here, key=lambda i: digest(17, i)):
                    if size[i] > left:
                        break
                    last.append(i)
                    left -= size[i]
                break
            for e in range(1, epochs + 2):
                want += [(i, s, e, block[i], digest("17/block", f"s{s}", block[i], e)) for i in (block if e <= epochs else last)]
        drop = lambda x: [y for y in x if size[y[0]]]  # noqa: E731  rows without tokens go with their neighbours
        assert drop(got) == drop(sorted(want))


def test_links_beside_brute_force(spark):
    """Thousands of links of all forms: the components, and blocks and allows that they carry."""
    r = random.Random(5)
    hosts = ["a.com", "b.net", "c.org", "d.com"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['x', 'de', 'fr', 'de'])}/{i}" for i in range(3000)]
    rows, edges = [], []
    for i, u in enumerate(urls):
        html = "<p>no link"
        if r.random() < 0.6:
            target = r.choice(urls) if r.random() < 0.97 else "http://hub.net/h"
            host, path = target[7:].split("/", 1)
            same = host == u[7:].split("/", 1)[0]
            forms = [target, f"//{host}/{path}", target.replace("http:", "https:") + "#f", f"http://{host}/q/../{path}"]
            forms += [f"/{path}", f"../{path}", f"./../{path}?"[:-1]] if same else []
            written = r.choice(forms).replace("/", r.choice(["/", "&#47;", "&#x2f;"]), 1)
            html = r.choice(['<link rel="canonical" href="{}">', "<LINK HREF='{}' REL=Canonical />", '<meta http-equiv="refresh" content="0; url={}">', "<!-- <link rel=canonical href=/no> --><link rel=canonical href={}>"]).format(written)
            edges.append((u[7:], target[7:]))
        elif r.random() < 0.2:
            html = f'<!-- <link rel="canonical" href="{r.choice(urls)}"> -->'
        rows.append((i, u, html))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    rule = lambda n: "allow" if n.split("/")[0].endswith("org") or "/fr/" in n and ".com/" in n else "block" if "/de/" in n and ".com/" in n else None
    groups = {}
    for n in list(up):
        groups.setdefault(find(n), set()).add(rule(n))
    want = {}
    for i, u in enumerate(urls):
        own, alias = rule(u[7:]), groups.get(find(u[7:]), set())
        want[i] = own or ("allow" if "allow" in alias else "block" if "block" in alias else "allow")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df = url_filter.url_filter(pages)
    got = {x["page_id"]: x["verdict"] for x in df.collect()}
    assert got == want and len(set(want.values())) == 2
    assert "Python" not in df._jdf.queryExecution().toString() and any(rule(u[7:]) is None and want[i] == "block" for i, u in enumerate(urls))


@pytest.mark.parametrize("hub", [2, 256])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components_module, "HUB_EDGES", hub)
    r = random.Random(6)
    edges = [(1, i) for i in range(100, 500)] + [(7000 + i, 6999) for i in range(300)] + [(r.randint(0, 4000), r.randint(0, 4000)) for _ in range(1500)] + [(i, i + 1) for i in range(8000, 8100)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_tables_go_with_their_scope(spark):
    folder = tables.shared_folder(spark).removeprefix("file://")
    here = lambda: {p.name for p in __import__("pathlib").Path(folder, "docloom").glob("*")}
    before = here() if __import__("os").path.isdir(f"{folder}/docloom") else set()
    with tables.scratch():
        a = tables.written(spark.range(3), "a")
        with tables.scratch():
            b = tables.written(spark.range(4), "b", keep=True)
            tables.written(spark.range(5), "c")
        assert b.count() == 4 and {n.split("-")[0] for n in here() - before} == {"a", "b"}
        tables.drop(a)
        assert {n.split("-")[0] for n in here() - before} == {"b"}
    assert here() == before
    with tables.scratch():
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        assert out.count() > 0 and len(here() - before) <= 2  # the last stage's input and its plan
    assert here() == before


@pytest.mark.parametrize("n", [0, 1])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(5, [1.0, 2.0], 9)] * n + [(6, None, 9)] * n, "vec_id int, embedding array<float>, rep int")
    assert rows_of(vector_dedup.near_vectors(df)) == sorted(["(5, 0, 5, True)", "(6, 0, 6, True)"][: 2 * n])


def test_planted_vectors(spark, monkeypatch):
    """Pairs at 0.90 to 0.93, a hot group, repeated ids and copies: links are real, nine tenths or more are found, and copies all."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "CALL_ROWS", 2000)
    r = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(r.normal(size=(1500, 64)))
    step = r.normal(size=x.shape)
    step = unit(step - (step * x).sum(1, keepdims=True) * x)
    c = r.uniform(0.9, 0.93, (1500, 1))
    hot = unit(x[:1] + 0.02 * unit(r.normal(size=(700, 64))))
    every = np.concatenate([x, c * x + np.sqrt(1 - c**2) * step, hot, x[:200]]).astype(np.float32)
    ids = [*range(len(every) - 1), 3]
    got = vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, every, strict=True)], "vec_id long, embedding array<float>").repartition(5)).toPandas()
    u = unit(every.astype(float))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    one = got[got.vec_id != 3].set_index("vec_id").sort_index()
    want = near.sum(1)[[i for i in range(len(every) - 1) if i != 3]]
    assert (one.n_links.to_numpy() <= want).all() and one.n_links.sum() >= 0.9 * want.sum()
    pairs = [i for i in range(1500) if i != 3 and near[i, 1500 + i]]
    assert np.mean([one.component_id[i] == one.component_id[1500 + i] for i in pairs]) >= 0.9
    assert one.component_id[3000:3700].nunique() == 1 and all(one.component_id[3700 + i] == one.component_id[i] for i in range(4, 199))


@pytest.mark.parametrize("n", [1_000, 100_000, 10_000_000, 1_000_000_000])
def test_vector_recall_at_sizes(n):
    """Tables chosen for many rows meet pairs just above the threshold often enough."""
    r = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(r.normal(size=(6000, 64)))
    step = r.normal(size=x.shape)
    step = unit(step - (step * x).sum(1, keepdims=True) * x)
    c = r.uniform(0.9, 0.92, (6000, 1))
    chosen, mean, matrices = vector_dedup.fitted(n, 64, x, vector_dedup.Search())
    assert vector_dedup.met(chosen, *(vector_dedup._codes(v, mean, matrices) for v in (x, c * x + np.sqrt(1 - c**2) * step))) >= 0.9


def test_groups_of_many_sets(spark, monkeypatch):
    """Two groups of one head each with many sets: their members meet in blocks, and links across groups are found."""
    monkeypatch.setattr(shingle_join, "LIST_BLOCK", 8)
    monkeypatch.setattr(shingle_join, "MOST", 400)
    r = random.Random(9)
    made = {}

    def group_of(t):
        x = next(shingle_join.shingle_sets([t]))
        return shingle_join._group(x)

    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(1500):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 4])):
            w[r.randrange(150)] = f"v{r.randint(0, 500)}"
        made.setdefault(group_of(" ".join(w)), []).append(" ".join(w))
    texts = [t for g in sorted(made, key=lambda g: -len(made[g]))[:12] for t in dict.fromkeys(made[g][:40])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert sum(len(set(v)) > 1 for v in made.values()) > 1
    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for t in texts]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {x["doc_id"]: x["component_id"] for x in shingle_join.shingle_components(documents(spark, rows).repartition(3)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    seen = []
    real = shingle_join._group_links
    monkeypatch.setattr(shingle_join, "_group_links", lambda *a: seen.append(1) or real(*a))
    assert {x["doc_id"]: x["component_id"] for x in shingle_join.shingle_components(documents(spark, rows)).collect()} == got and seen
