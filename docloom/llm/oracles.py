"""SQL of the queries that SQL can express, for a second engine over whole tables."""

from __future__ import annotations

from docloom.llm.quality_rules import SYMBOLS, Limits
from docloom.llm.secret_scan import ADDED_RULES, BASE_RULES, Rule
from docloom.llm.source_mixing import Mix
from docloom.llm.url_filter import DEFAULT_RULES

_SPREAD = """
walk AS (SELECT id, id AS c FROM nodes UNION SELECT e.b, w.c FROM walk w JOIN edges e ON e.a = w.id WHERE w.c <= e.b),
reached AS (SELECT id, min(c) AS component_id FROM walk GROUP BY id)"""

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_SPREAD},
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM reached LEFT JOIN n ON a = id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
sized AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n FROM s), one AS (SELECT doc_id, unnest(s) AS t FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
nodes AS (SELECT doc_id AS id FROM documents), {_SPREAD}
SELECT id AS doc_id, n AS n_shingles, component_id FROM reached JOIN sized ON doc_id = id"""


def _op6() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in DEFAULT_RULES)
    return rf"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fit AS (SELECT page_id, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM h LEFT JOIN fit ON fit.page_id = h.page_id AND k = 1"""


def _op1(mix: Mix = Mix()) -> str:
    """The exponent by halving, block orders and edges by plain windows."""

    def entropy(a: str) -> str:
        return f"ln(sum(exp({a} * x))) - {a} * sum(x * exp({a} * x)) / sum(exp({a} * x))"

    def epochs(a: str) -> str:
        return f"exp(({a} - 1) * min(x)) * sum(exp(x)) / sum(exp({a} * x))"

    def hashed(*parts: str) -> str:
        return f"('0x' || md5({" || '|' || ".join(parts)})[1:15])::BIGINT"

    def halved(name: str, start: str, goes_up: str) -> str:
        return f"""{name} AS (SELECT 0 AS it, {start} AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT it + 1, CASE WHEN {goes_up} THEN any_value((low + high) / 2) ELSE any_value(low) END, CASE WHEN {goes_up} THEN any_value(high) ELSE any_value((low + high) / 2) END FROM {name}, share WHERE it < 60 GROUP BY it)"""

    mid, whole = "any_value((low + high) / 2)", "(SELECT a FROM first)"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, {hashed(f"'{mix.seed}'", "coalesce(doc_id::VARCHAR, '')")} AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
total AS (SELECT k, sum(tokens)::BIGINT AS t FROM d GROUP BY k), most AS (SELECT sum(t)::DOUBLE AS every, max(t)::DOUBLE AS largest FROM total),
share AS (SELECT ln(t / largest) AS x FROM total, most WHERE t > 0),
goal AS (SELECT {mix.entropy}::DOUBLE * ln(count(*)) AS target, {entropy("1.0::DOUBLE")} AS top, {entropy("0.0::DOUBLE")} AS flat, count(*) AS n, min(x) AS least, {epochs("1.0::DOUBLE")} AS e1 FROM share),
{halved("by_entropy", "0.0::DOUBLE", f"any_value((SELECT target FROM goal)) <= ln(sum(exp((low + high) / 2 * x))) - {mid} * sum(x * exp((low + high) / 2 * x)) / sum(exp((low + high) / 2 * x))")},
first AS (SELECT CASE WHEN n = 0 OR least = 0 OR top >= target THEN 1.0 WHEN flat < target THEN 0.0 ELSE (SELECT low FROM by_entropy WHERE it = 60) END::DOUBLE AS a FROM goal),
{halved("by_epochs", whole, f"exp(({mid} - 1) * min(x)) * sum(exp(x)) / sum(exp((low + high) / 2 * x)) > {mix.repeats}::DOUBLE")},
power AS (SELECT CASE WHEN (SELECT exp((any_value(a) - 1) * min(x)) * sum(exp(x)) / sum(exp(a * x)) FROM share, first) <= {mix.repeats}::DOUBLE OR least = 0 THEN {whole} WHEN e1 > {mix.repeats}::DOUBLE THEN 1.0 ELSE (SELECT high FROM by_epochs WHERE it = 60) END::DOUBLE AS a FROM goal),
source AS (SELECT k, t, greatest(1, ceil(t / {mix.block_tokens}.0::DOUBLE))::BIGINT AS n_blocks, CASE WHEN t > 0 THEN floor(every * exp(a * ln(t / largest)) / (SELECT sum(exp(p.a * x)) FROM share, power p) + 1e-6) ELSE 0 END::BIGINT AS goal FROM total, most, power),
plan AS (SELECT *, CASE WHEN t > 0 THEN goal // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN goal % t ELSE 0 END AS rest FROM source),
placed AS (SELECT d.*, h % n_blocks AS b, whole, rest FROM d JOIN plan USING (k)),
block AS (SELECT *, {hashed(f"'{mix.seed}/block'", "k", "b::VARCHAR", "(whole + 1)::VARCHAR")} AS o FROM (SELECT k, b, whole, rest, sum(tokens) AS tokens FROM placed WHERE rest > 0 GROUP BY ALL)),
edge AS (SELECT k, b AS edge_b, o AS edge_o, rest - held + tokens AS room FROM (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY o, b) AS held FROM block) WHERE held > rest QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, b) = 1),
last AS (SELECT k, max(h) AS last_h FROM (SELECT k, h, room, sum(tokens) OVER (PARTITION BY k ORDER BY h) AS held FROM (SELECT k, h, room, sum(tokens) AS tokens FROM placed JOIN edge USING (k) WHERE b = edge_b AND tokens > 0 GROUP BY ALL)) WHERE held <= room GROUP BY k),
copied AS (SELECT p.*, whole + coalesce(o2 < edge_o OR (o2 = edge_o AND b < edge_b) OR (b = edge_b AND h <= coalesce(last_h, -1)), false)::BIGINT AS copies FROM (SELECT *, {hashed(f"'{mix.seed}/block'", "k", "b::VARCHAR", "(whole + 1)::VARCHAR")} AS o2 FROM placed) p LEFT JOIN edge USING (k) LEFT JOIN last USING (k))
SELECT doc_id, source, tokens AS n_tokens, e::INTEGER AS mix_epoch, b AS mix_block, {hashed(f"'{mix.seed}/block'", "k", "b::VARCHAR", "e::VARCHAR")} AS mix_order FROM copied, unnest(range(1, copies + 1)) AS u(e)"""


def _op5(rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, base: int = len(BASE_RULES)) -> str:
    """Each rule by the second engine's own regular expressions; characters between matches are counted by cutting there."""
    parts = []
    for i, r in enumerate(rules):
        pattern = (r.pattern + (f"(?:{r.tail})?" if r.tail else "")).replace("'", "''")
        value = f"m[i][length(regexp_extract(m[i], '^(?:{r.head.replace("'", "''")})'))+1:]" if r.head else "m[i]"
        parts.append(f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, m[i] AS v
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split(regexp_replace(text, '{pattern}', chr(1), 'g'), chr(1)) AS g FROM d), unnest(range(1, len(m) + 1)) AS u(i) WHERE length(m[i]) >= {r.min_length} AND length({value}) >= {r.min_value}""")
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS text FROM documents), found AS ({" UNION ALL ".join(parts)}),
told AS (SELECT doc_id, rank, s, kind || ':' || s::BIGINT || ':' || (s + length(v))::BIGINT AS t FROM found),
each AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(t, ',' ORDER BY s, rank) FILTER (rank < {base}), '')) AS base_sha256, string_agg(t, ',' ORDER BY s, rank) AS spans FROM told GROUP BY doc_id)
SELECT id AS doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN each USING (doc_id)"""


def _op8(limits: Limits = Limits()) -> str:
    """Windows as strings, and each word's windows as a frame of rows."""
    lengths = [k for k, _ in limits.coverage]
    window = ", ".join(f"CASE WHEN p + {k} <= n + 1 THEN string_agg(v, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS g{k}" for k in sorted({3, *lengths}))
    later = ", ".join(f"g{k} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{k} ORDER BY p) > 1 AS later_{k}" for k in lengths)
    covered = ", ".join(f"bool_or(later_{k}) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS in_{k}" for k in lengths)
    share = ", ".join(f"coalesce(sum(size) FILTER (in_{k}), 0)::DOUBLE / greatest(1, sum(size)) AS coverage_{k}" for k in lengths)
    good = " AND ".join(f"coverage_{k} <= {most}::DOUBLE" for k, most in limits.coverage)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS v, len(w) AS n FROM d),
gram AS (SELECT r, p, length(v) AS size, {window} FROM word),
seen AS (SELECT r, p, size, g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS twice, {later} FROM gram),
held AS (SELECT r, size, bool_or(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in_3_twice, {covered} FROM seen),
by_word AS (SELECT r, count(*) FILTER (in_3_twice) AS n_repeat_words, {share} FROM held GROUP BY r),
line AS (SELECT r, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS size, row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS again FROM (SELECT r, l[i] AS l, i FROM (SELECT r, string_split(text, chr(10)) AS l FROM d), unnest(range(1, len(l) + 1)) AS u(i))),
by_line AS (SELECT r, count(*) FILTER (again AND size > 0) AS n_dup_lines, coalesce(sum(size) FILTER (again), 0)::DOUBLE / greatest(1, sum(size)) AS line_coverage FROM line GROUP BY r),
every AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, line_coverage, {", ".join(f"coalesce(coverage_{k}, 0) AS coverage_{k}" for k in lengths)}
  FROM d JOIN by_line USING (r) LEFT JOIN by_word USING (r)),
judged AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM every)
SELECT *, NOT base_failed AND line_coverage <= {limits.line_coverage}::DOUBLE AND n_symbols <= {limits.symbols_per_word}::DOUBLE * n_words AND {good} AS kept FROM judged"""


#: The pages of the test tables have no canonical links or redirects, so op6 needs no components there.
ORACLES = {"op1_source_mixing": _op1(), "op2_vector_dedup": OP2, "op4_shingle_join": OP4, "op5_secret_scan": _op5(), "op6_url_filter": _op6(), "op8_quality_rules": _op8()}
