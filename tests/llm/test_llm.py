"""The operators beside brute force, on small tables with nulls, empty and repeated rows and other columns."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import page_text as page_text_module
from docloom.llm import piece_codec, quality_net, quality_rules, secret_scan, shingle_join, source_mixing, tables, url_filter, vector_dedup
from docloom.llm import token_counts as token_counts_module
from docloom.llm.components import components
from docloom.llm.page_text import common, lines, main_text, page_text
from docloom.llm.piece_codec import PieceCodec, piece_decode, piece_encode
from docloom.llm.queries import ORACLES, queries
from docloom.llm.token_counts import PrefixCounter, fits, prefix_tables, token_counts, truncated

DATA = "/root/testdata/sf0.001"
BITS = ["a", "th", "he", " ", "  ", "\n", "\t", "'s", "'t", "12", "é", "ß", "漢", "🙂", "▁", "<s>", "<|endoftext|>", "\x1c", "\x85", "　", "\x00", "...", "aaaa", " " * 20, "\r\n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, n long, token string"


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(BITS, k=r.randint(0, 30))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "t") for i, t, s in rows], DOCS)


def smallest(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == smallest(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), PrefixCounter(open(path, encoding="utf-8").read())
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for x in texts(1000):
        assert c.count(x) == size(x), repr(x)
    word = "internationalisation" * 3
    assert c.prefixes(word.encode()) == [size(word[:i]) for i in range(len(word) + 1)]
    for block in (1 << 16, 7):
        monkeypatch.setattr(token_counts_module, "BLOCK", block)
        for x in [*texts(250, 5), "it's we're don't ''s 'r", "a" + " " * 40 + "b <|endof<|endoftext|><|endoftext|>", "x  <|endoftext|> y"]:
            want = [size(x[:i]) for i in range(len(x) + 1)]
            assert c.at_every_prefix(x).tolist() == want, repr(x)
            for budget in (0, 1, 3, 9):
                assert c.measured(x, budget) == (want[-1], max(i for i, n in enumerate(want) if n <= budget))
    docs = frame(spark, [(1, None, "s"), (2, "", "s"), (3, "hi " * 2000, "s"), (3, "hi " * 2000, "s"), (4, "don't  stop", "s")])
    got = {r["doc_id"]: r for r in token_counts(docs, path).collect()}
    assert got[1]["n_tokens"] == got[2]["n_bytes"] == 0 and got[3]["over_limit"] and size(("hi " * 2000)[: got[3]["cut_chars"]]) == 1024
    tables = prefix_tables(docs, path)
    assert {r["doc_id"]: list(r["counts"]) for r in tables.collect()}[4] == [size("don't  stop"[:i]) for i in range(1, 12)]
    cut = {r["doc_id"]: r["n"] for r in tables.select("doc_id", fits(F.col("counts"), 1024).alias("n")).collect()}
    short = {r["doc_id"]: r["text"] for r in truncated(docs, path, 1024).collect()}
    assert cut == {i: r["cut_chars"] for i, r in got.items()} and short[1] is None and all(len(short[i] or "") == n for i, n in cut.items())


def test_piece_codec(spark, monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    s, c = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(open(path, "rb").read())
    for x in [*texts(1000, 3), "abcthe" * 2000, "漢" * 500 + " " * 300]:
        ids = c.encode(x)
        assert ids == s.encode(x) and c.decode(ids) == s.decode(ids), repr(x)
    fresh = PieceCodec(open(path, "rb").read())
    monkeypatch.setattr(piece_codec, "BLOCK", 8)
    monkeypatch.setattr(piece_codec, "SLICE", 5)
    for x in [*texts(400, 4), "streamingviterbi" * 40, "漢" * 50]:
        assert fresh.encode(x) == s.encode(x), repr(x)
    docs = frame(spark, [(1, None, "s"), (2, "Hello  you\n", "s"), (3, "a▁b", "s")])
    enc = piece_encode(docs, path)
    got = {r["doc_id"]: r for r in enc.collect()}
    assert got[1]["ids"] == [] and got[2]["round_trip"] and not got[3]["round_trip"]
    assert {r["doc_id"]: r["text"] for r in piece_decode(enc, path).collect()} == {1: "", 2: "Hello  you\n", 3: "a b"}
    for wrong in (("ids",), ("doc_id", "doc_id"), ("nothing",)):
        with pytest.raises(ValueError):
            piece_encode(docs.withColumn("ids", F.lit(1)), path, keep=wrong)
    with pytest.raises(ValueError):
        piece_decode(enc, path, keep=("text",))


def test_viterbi_streams():
    """Pieces are given out when all paths meet: a little behind the window, however long the text; all of them in order."""
    c = PieceCodec(open(P.path("piece_bpe_32k.model"), "rb").read())
    r = random.Random(5)
    for x in ["a" * 3000, "abcthe" * 500, "internationalization" * 60 + "xqzj" * 90, "漢" * 300, "".join(r.choices("etaoinshrdlu", k=1500))]:
        fed = given = 0
        late = []

        def feed():
            nonlocal fed
            for ch in x:
                fed += 1
                yield ch

        out = []
        for piece in c.viterbi(feed()):
            out.append(piece)
            given += len(piece)
            late.append(fed - given)
        assert out == c.merged(x) and max(late) <= 6 * c.longest


def test_viterbi_runs_on_all_texts(spark, monkeypatch):
    """Every distinct stretch of the table goes through the search."""
    c = PieceCodec(open(P.path("piece_bpe_32k.model"), "rb").read())
    seen, search = set(), c.viterbi

    def counted(blocks):
        blocks = list(blocks)
        seen.add("".join(blocks))
        return search(blocks)

    monkeypatch.setattr(c, "viterbi", counted)
    every = [t for (t,) in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if t]
    want = set()
    for t in every:
        c.encoded(t)
        for block in c.blocks(t):
            for chunk in block:
                cuts = [0, *(i for i, p in enumerate(zip(chunk, chunk[1:]), 1) if p not in c.joined), len(chunk)]
                want |= {chunk[a:b] for a, b in zip(cuts, cuts[1:])}
    assert seen == want


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_quality_rules(spark):
    r = random.Random(4)
    some = ["".join(r.choices(["a", "b", " ", "\n", "é#", " x y z ", "\x1c"], k=r.randint(0, 200))) for _ in range(300)]
    some += ["a b c a b d " * 30, "a b " * 3, "x " * 200, "one two three one two"]
    for t in some:
        found = quality_rules.measure(t, tuple(range(1, 12)))
        assert found[:5] == brute_measures(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k, share in found[6].items():
            seen, covered = set(), set()
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                covered |= set(range(i, i + k)) if g in seen else set()
                seen.add(g)
            assert abs(share - sum(len(w[i]) for i in covered) / max(1, sum(map(len, w)))) < 1e-9
        lines, dup = set(), 0
        for line in t.split("\n"):
            inside = sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            dup += inside * (line in lines)
            lines.add(line)
        assert abs(found[5] - dup / max(1, sum(map(len, w)))) < 1e-9
    with pytest.raises(ValueError):
        quality_rules.Limits(coverage=((0, 0.5),))
    good, bad = " ".join(f"word{i}" for i in range(80)), "spam " * 100
    docs = frame(spark, [(1, good, "s"), (2, bad, "s"), (3, None, "s"), (4, "", "s"), (5, good.replace(" ", " ### "), "s"), (1, good, "s")])
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(docs).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [True, False, False, False, False] and not got[5]["base_failed"]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 1]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_scan(spark):
    s = secret_scan.scanner(secret_scan.BASE_RULES + secret_scan.ADDED_RULES)
    r = random.Random(6)
    bits = ["password", "PassWord", "token", "secret", "api_key", "apikey", ":", "=", " ", '"', "'", "abcdef", "abc", "0123456789", "AKIA", "ABCDEFGHIJ", "deadbeefdeadbeef", "é", "漢", "/", "\n", ".", "g"]
    for _ in range(3000):
        t = "".join(r.choices(bits, k=r.randint(0, 25)))
        assert [x for x in s.spans(t) if x[1] < 3] == brute_spans(t), repr(t)
    text = "é token=abcdefgh AKIA" + "A1" * 9
    docs = frame(spark, [(1, text, "s"), (2, None, "s"), (3, "clean", "s")])
    got = {x["doc_id"]: x for x in secret_scan.secret_scan(docs).collect()}
    assert got[1]["spans"] == "assign:2:16,access:17:39" and got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["n_hex"] == 0
    clean = {x["doc_id"]: x for x in secret_scan.redacted(docs).collect()}
    assert clean[1]["text"] == "é [assign] [access]" and clean[1]["n_chars"] == 19 and clean[2]["text"] is None and clean[3]["text"] == "clean"


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", " "])
@pytest.mark.parametrize("heads", ["", "Proc-Type: 4,ENCRYPTED{0}DEK-Info: AES-128-CBC,0A1B2C{0}{0}"])
def test_private_keys(gap, heads):
    s = secret_scan.scanner(secret_scan.BASE_RULES + secret_scan.ADDED_RULES)
    body = gap.join(["MIIEpAIBAAKCAQEA" + "aB3+/xYz" * 6] * 3 + ["c29tZQ=="])
    key = f"-----BEGIN RSA PRIVATE KEY-----{gap}{heads.format(gap)}{body}"
    whole = f"{key}{gap}-----END RSA PRIVATE KEY-----"
    assert secret_scan.redact(f"é see {whole}. Then text", s) == "é see [private_key]. Then text"
    assert secret_scan.redact(f"{whole}\n{whole} and", s) == "[private_key]\n[private_key] and"
    assert secret_scan.redact(f"cut: {key}", s) == "cut: [private_key]"
    assert secret_scan.redact("the line -----BEGIN PRIVATE KEY----- opens a key", s) == "the line [private_key] opens a key"


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = smallest(ids, edges)
    return {i: (len(sets[i]), low[i]) for i in ids}


@pytest.mark.parametrize("most", [3, 40])
def test_shingle_join(spark, monkeypatch, most):
    monkeypatch.setattr(shingle_join, "MOST", most)
    monkeypatch.setattr(shingle_join, "LIST_BLOCK", 16)
    r = random.Random(7)
    new = lambda n, v=300: [f"W{r.randint(0, v)}" for _ in range(n)]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        return w

    passage, big = new(55), new(200)
    rows = [new(r.randint(0, 9), 4) for _ in range(80)]
    for _ in range(60):
        d = new(r.randint(20, 200))
        rows += [d, edit(d, r.randint(0, 4))]
    rows += [passage + new(r.randint(3, 100)) for _ in range(60)] + [edit(big, r.randint(0, 7)) for _ in range(70)] + [edit(big[:80] + passage, 2) for _ in range(40)]
    ending = new(120)  # about half of these have one head and size, with different sets
    rows += [ending + [f"t{i}"] for i in range(30)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(rows)] + [(900, None, "s"), (901, "", "s"), (902, " \n", "s")]
    docs = frame(spark, rows).repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in shingle_join.shingle_components(docs).collect()}
    assert got == brute_join([x[:2] for x in rows])
    if most == 40:
        assert sorted(x["doc_id"] for x in shingle_join.keep_one(docs).collect()) == sorted(i for i, (_, c) in got.items() if i == c)
        assert shingle_join.shingle_components(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (1, a, "s"), (2, a + " end", "s"), (3, c, "s"), (3, b, "s"), (4, b + " end", "s"), (4, c + " end", "s"), (2, c + " tail", "s"), (5, "", "s"), (5, "", "s"), (None, a, "s")]
    got = sorted((x["doc_id"] or 0, x["text"]) for x in shingle_join.keep_one(frame(spark, rows)).collect())
    assert got == sorted([(1, a), (2, c + " tail"), (3, b), (5, ""), (5, ""), (0, a)])


@pytest.mark.parametrize("tables", [None, vector_dedup.Tables(2, 32, 8, 1)])
def test_near_vectors(spark, monkeypatch, tables):
    if tables:
        monkeypatch.setattr(vector_dedup, "choose", lambda n, bits, s: tables)
    monkeypatch.setattr(vector_dedup, "BLOCK", 50)
    r = np.random.default_rng(0)
    base = r.normal(size=(300, 32))
    x = np.concatenate([base, base + r.normal(size=base.shape) * r.uniform(0.05, 0.55, (300, 1)), base[:30], base[:1] + r.normal(size=(120, 32)) * 0.01])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0, None]), (904, [float("nan")] * 32), (None, [1.0] * 32)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    real = got[got.vec_id < 900].set_index("vec_id").sort_index()
    assert (real.n_links.to_numpy() <= near.sum(1)).all() and real.n_links.sum() >= 0.9 * near.sum()
    assert (got[got.vec_id >= 900].n_links == 0).all() and len(got) == len(rows)
    copies = smallest(range(len(x)), zip(*np.nonzero(u @ u.T >= 0.999), strict=True))
    assert all(real.component_id[i] == real.component_id[c] for i, c in copies.items())


@pytest.mark.parametrize("norm", [0.0, 0.7, 0.8])
@pytest.mark.parametrize("n", [8_000, 1_000_000])
def test_vector_tables_with_common_mean(norm, n):
    r = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    away = unit(np.concatenate([np.zeros((8_000, 1)), r.normal(size=(8_000, 63))], 1))
    step = np.concatenate([np.zeros((2_000, 1)), r.normal(size=(2_000, 63))], 1)
    step = unit(step - (step * away[:2_000]).sum(1, keepdims=True) * away[:2_000])
    c = (r.uniform(0.9, 0.93, (2_000, 1)) - norm**2) / (1 - norm**2)
    place = lambda g: norm * np.eye(64)[0] + np.sqrt(1 - norm**2) * g
    x, y = place(away), place(c * away[:2_000] + np.sqrt(1 - c**2) * step)
    tables, mean, matrices = vector_dedup.fitted(n, 64, x, vector_dedup.Search())
    assert vector_dedup.met(tables, *(vector_dedup._codes(v, mean, matrices) for v in (x[:2_000], y))) >= 0.9


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(1, 40), "big" if i % 3 else f"s{i % 4}") for i in range(600)] + [(700, "w w", None), (701, None, "empty"), (5, "w", "big")]
    docs = frame(spark, rows)
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    mix = source_mixing.Mix(entropy=0.9, repeats=3.0, block_tokens=200)
    got = source_mixing.mixed(docs, mix).toPandas()
    taken = got.assign(n=got.text.fillna("").str.split().map(len)).groupby(got.source.fillna("?")).n.sum()
    p = np.array([n for n in tokens.values() if n], float) / sum(tokens.values())
    grid = np.linspace(0, 1, 200_001)
    h = lambda a: -sum(q * np.log(q) for q in (p**a / (p**a).sum()))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if h(mid) >= 0.9 * np.log(len(p)) else (low, mid)
    epochs = lambda a: (p**a / (p**a).sum() / p).max()
    a = low if epochs(low) <= 3 else next(x for x in grid if x >= low and epochs(x) <= 3)
    w = dict(zip([s for s, n in tokens.items() if n], p**a / (p**a).sum(), strict=True))
    for s, share in w.items():
        goal = share * sum(tokens.values())
        assert goal - 40 <= taken[s if s is not None else "?"] <= goal + 1
    assert "empty" in set(got.source) and got.mix_epoch.max() <= 4
    again = source_mixing.mixed(docs.repartition(5), mix).toPandas()
    key = ["doc_id", "source", "mix_epoch", "mix_block", "mix_order"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    cover = source_mixing.mixed(docs, source_mixing.Mix(repeats=2.0, budget="cover")).toPandas()
    assert set(cover.doc_id) == {x[0] for x in rows} and cover.mix_epoch.max() <= 3
    assert source_mixing.mixed(docs.limit(0)).count() == 0
    assert source_mixing.mixed(docs.withColumn("text", F.lit(""))).count() == len(rows)


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.org/es/x", ""), (2, "https://B.example.org/en/12?q", ""), (3, "http://x.net/1", link.format("http://shop.com/de/9")), (4, "http://x.net/2", ""),
        (5, "http://y.net/1#f", '<meta http-equiv="refresh" content="0; url=http://x.net/1">'), (6, "http://z.net/1", link.format("http://ok.com/fr/1")), (7, "http://z.net/1", link.format("http://bad.com/de/1")),
        (8, None, None), (9, "no scheme", ""), (10, "http://example.org/en/2", ""), (11, "http://myexample.org/es/", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("org/", "allow"), 11: ("org/", "allow")}
    assert {k: (v["rule"], v["verdict"]) for k, v in got.items()} == want
    assert got[2]["host"] == "b.example.org" and got[2]["path"] == "/en/12" and got[8]["host"] == got[9]["path"] == ""


def test_page_text(spark):
    page = '<html><head><title>T</title></head><body><header>Top</header><nav>menu</nav><div class="cookie-notice">Accept</div><article><h1>H &amp; I</h1><p>One  two<script>var t="</p>"</script><p>three<div class="comments">bad</div></article><footer>f</footer>'
    assert main_text(lines(page), []) == "H & I One two three"
    loose = lambda x: f"<body><p>Site name</p><p>Own words of page {x} that differ from others</p><p>All rights</p>"
    rows = [(1, "http://h.com/a/1", loose("one")), (2, "http://h.com/a/2", loose("two")), (3, "http://h.com/a/3", loose("two")), (4, "http://k.com/", None), (5, None, page)]
    got = {r["page_id"]: r["text"] for r in page_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[4] == "" and got[5] == "H & I One two three" and "Own words" in got[1] and len(got) == 5
    a, b = list("abcxdefg"), list("abyydzfg")
    assert len(common(a, b)) == 5
    assert main_text(lines(loose("one")), [lines(loose("two"))]) == "Own words of page one that differ from others"


def test_page_text_aligns_marked_pages():
    page = lambda x: lines(f"<body><article><p>Posted by the editors<p>The article on {x} says much about {x}</article><p>All rights")
    a, b, c = (page(x) for x in ("ants", "bees", "cows"))
    assert main_text(a, [b, c]) == "The article on ants says much about ants"
    # a copy keeps the article, and loses what other pages have
    assert main_text(a, [a[:2] + [("Copy", False)], b], [c]) == "The article on ants says much about ants"
    tale = [("A tale that all of these pages tell in the same words, at some length", False)]
    assert main_text([*tale, ("Jan 1", False)], [[*tale, ("Jan 2", False)], [*tale, ("Jan 3", False)]]).startswith("A tale")
    teaser = lines("<body><p>Site<p>A long text that stands outside of any marked element of the page<article>Teaser</article>")
    assert main_text(teaser, [lines("<p>Site<p>Other")]) == "A long text that stands outside of any marked element of the page Teaser"


@pytest.mark.parametrize("wrap", ['<main class="content with-sidebar">{}</main>', '<div id="page" class="no-sidebar">{}</div>', '<article class="ad-free">{}</article>', '<main class="search">{}</main>', '<div class="social"><b>x</b><div class="ad">{}</div></div>'])
def test_page_text_class_words(wrap):
    assert "The text" in main_text(lines(wrap.format('<div class="ad">Buy</div><article>The text</article>')), [])
    assert "Buy" not in main_text(lines(wrap.format('<div class="top ad">Buy</div><article>The text</article>')), [])
    assert main_text(lines('<div class="with-sidebar">Text<div class="sidebar">Links</div></div>'), []) == "Text"


def test_page_text_ranges_and_copies(spark, monkeypatch):
    page = lambda x: f"<body><p>The name of this site and what it is all about<p>Own words of page {x} alone<p>All rights of these pages reserved"
    words = [f"{i:02} {'xyz'[i % 3]}" for i in (*range(8), *[8] * 7, *range(15, 24))]
    rows = [(i, f"http://{'h' if i < 20 else 'k'}.com/{i:02}", page(w)) for i, w in enumerate(words)] + [(None, "http://h.com/03", page("none")), (3, "http://h.com/03", page(words[3]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(repr, page_text(pages).collect()))
    assert len(whole) == len(rows) and all("'Own " in x and "rights" not in x for x in whole)
    for size in (1, 2, 5):
        monkeypatch.setattr("docloom.llm.page_text.RANGE", size)
        assert sorted(map(repr, page_text(pages).collect())) == whole


def test_quality_net(spark):
    r = random.Random(9)
    good = [" ".join("".join(r.choices(["th", "an", "er", "in"], k=3)) for _ in range(r.randint(30, 300))) for _ in range(160)]
    bad = [" ".join("".join(r.choices(["th", "an"], k=2)) + "%%%" for _ in range(r.randint(30, 300))) for _ in range(160)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(good + bad)] + [(900, None, "s"), (901, "", "s")])
    labels = spark.createDataFrame([(i, int(i < 160)) for i in range(320) if i % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_net.score(docs, quality_net.fit(docs, labels, quality_net.Training(texts=160, rounds=6))).toPandas().set_index("doc_id")
    held = [i for i in range(320) if i % 2 == 0]
    assert np.mean([got.predicted[i] == (i < 160) for i in held]) > 0.95 and got.score.between(0, 1).all() and got.score[900] == got.score[901]
    net = quality_net.Net(1)
    x, y, w = [b"some text to learn" * 30, b"", b"%%% other" * 90], np.array([1, 0, 0], np.float32), np.ones(3, np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, -(2 * y - 1) * net.forward(x)["z"])))
    for k, g in net.gradient(x, y, w).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][at], 1e-2
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 2e-4, k


def plain_score(net, text):
    """The score by plain loops over filter positions and chunks."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    n_parts = (len(text) + quality_net.WIDTH) // quality_net.PART + 1
    data = text + b" " * ((n_parts + 1) * quality_net.PART)
    parts = []
    for i in range(n_parts):
        best = np.full(quality_net.FILTERS, -np.inf)
        for at in range(i * quality_net.PART, (i + 1) * quality_net.PART, quality_net.STEP):
            best = np.maximum(best, p["embed"][list(data[at : at + quality_net.WIDTH])].ravel() @ p["filter"] + p["bias"])
        parts.append(np.maximum(best, 0))
    hidden, first = [], 0
    while True:
        hidden.append(np.tanh(np.max(parts[first : first + quality_net.PARTS], 0) @ p["hidden"] + p["hidden_bias"]))
        if first + quality_net.PARTS >= n_parts:
            break
        first += quality_net.HOP
    z = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)]) @ p["out"] + p["out_bias"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_depend_on_the_text_alone(spark, monkeypatch):
    r = random.Random(3)
    net = quality_net.Net(2)
    for k in net.p:
        net.p[k] = net.p[k] * 3
    some = [bytes(r.choices(range(32, 256), k=r.choice([0, 1, 40, 52, 53, 64, 199, 1000, 5000]))) for _ in range(60)]
    exact = net.precise()
    alone = [exact.score(x) for x in some]
    assert np.allclose(alone, [plain_score(net, x) for x in some], atol=2e-9) and len(set(alone)) > 30
    monkeypatch.setattr(quality_net, "STRIP", 3)
    assert np.allclose([exact.score(x) for x in some], alone, atol=2e-9)
    monkeypatch.undo()
    # training's pass over several texts agrees, whatever stands behind a text
    for order in ([*range(60)], [*range(59, -1, -1)], r.sample(range(60), 60)):
        z = net.forward([some[i] for i in order])["z"]
        assert np.allclose(1 / (1 + np.exp(-z.astype(float))), [alone[i] for i in order], atol=1e-4)
    rows = [(i, "".join(r.choices("abc d\né", k=r.randint(0, 400))), "s") for i in range(80)]
    rows += [(1000 + i, t, "s") for i, t, _ in rows]
    want = None
    for size in ("1", "7", "50", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for _ in range(2):
            r.shuffle(rows)
            got = {x["doc_id"]: x["score"] for x in quality_net.score(frame(spark, rows).repartition(3), net).collect()}
            want = want or got
            assert got == want and all(got[i] == got[i + 1000] for i in range(80))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quality_sample(spark):
    docs = frame(spark, [(i, f"{i} " * i, "s") for i in range(1, 60)] + [(7, "b", "s"), (7, "a", "s"), (8, None, "s"), (None, "x", "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 50)] + [(7, 0), (99, 1), (5, 3), (None, 1)], "doc_id long, quality int")
    whole = quality_net.sample(docs, labels, quality_net.Training(texts=1000))
    assert len(whole[0]) == 49 and b"7 " * 7 in whole[0] and b"a" not in whole[0] and max(map(len, whole[0])) == 49 * 3
    again = quality_net.sample(docs.repartition(7), labels.repartition(3), quality_net.Training(texts=1000))
    assert whole[0] == again[0] and (whole[1] == again[1]).all()
    few = quality_net.sample(docs, labels, quality_net.Training(texts=20, sample_bytes=400))
    assert 1 <= len(few[0]) < 20 and sum(map(len, few[0])) <= 400 and set(few[0]) <= set(whole[0])
    assert len(quality_net.sample(docs, labels, quality_net.Training(sample_bytes=0))[0]) == 1
    empty = quality_net.fit(docs.limit(0), labels.limit(0))
    assert quality_net.score(docs.limit(0), empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    norm = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert norm(queries()[name](spark, DATA).toPandas()) == norm(con.execute(ORACLES[name]).fetchdf())


def test_pipeline(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choices("abcdefghij", k=6)) + "z"
    base = [" ".join(word() for _ in range(80)) for _ in range(20)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)] + [(30, base[0] + " tail", "s0"), (31, base[1], "s1"), (32, "spam " * 90, "s1"), (33, None, "s2"), (34, base[2][::-1] + " token=abcdef123", "s2")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert set(docs.toPandas().doc_id) == {*range(20), 34}
    assert docs.filter("text like '%abcdef123%'").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert len(out) == docs.count() and out.round_trip.all()
    assert isinstance(corpus_pipeline.run(spark, DATA).toPandas(), pd.DataFrame)
