"""SQL for the queries, written from the operators' rules for a second engine."""

from __future__ import annotations

from docloom.functions.entities import PATTERNS
from docloom.functions.text import STOP_WORDS, SUFFIXES
from docloom.operators.compression import FILLERS
from docloom.operators.textrank import LEVELS
from docloom.operators.vectors import FOUND
from docloom.plans.inputs import BEGINNINGS, INVOICES_SQL


def _words(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '\S+'))"


def _flat(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _sentences(t: str) -> str:
    return rf"list_filter(string_split(regexp_replace({_flat(t)}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def _without_fillers(t: str) -> str:
    return _flat(rf"regexp_replace({t}, '(?i)\b(?:{'|'.join(FILLERS)})\b,?\s*', '', 'g')")


def _format(t: str) -> str:
    left = rf"regexp_replace({t}, '^\s+', '')"
    line = r"regexp_replace(l, '^\s+', '')"
    mark = rf"len(list_filter(string_split({t}, chr(10))[1:40], lambda l: regexp_matches({line}, '^(#[ 0-9]|```|[-*] )') OR (contains(l, '](') AND contains(l, '[')))) > 0"
    return f"CASE WHEN {t} IS NULL THEN 'unknown' WHEN {left} = '' THEN 'plaintext' WHEN starts_with(lower({left}[1:32]), '<!doctype html') OR starts_with(lower({left}[1:32]), '<html') OR (starts_with({left}, '<') AND contains({t}[1:2048], '</')) THEN 'html' WHEN {mark} THEN 'markdown' ELSE 'plaintext' END"


def _entities(source: str, columns: str) -> str:
    parts = []
    for i, (kind, p) in enumerate(PATTERNS.items()):
        # a separator of its own stands for each match, so that the text before it can be measured
        q = p.replace("'", "''").replace(r"\b(", r"\b(?:")
        parts.append(f"SELECT {columns}, {i} AS prio, '{kind}' AS entity_type, regexp_extract_all(text, '{q}') AS m, string_split(regexp_replace(text, '{q}', chr(1), 'g'), chr(1)) AS g FROM src")
    return f"""
WITH RECURSIVE src AS ({source}), raw AS ({" UNION ALL ".join(parts)}),
found AS (SELECT {columns}, prio, entity_type, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0))::BIGINT AS s, strlen(m[i])::BIGINT AS n
  FROM raw, unnest(range(1, len(m) + 1)) AS u(i)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, n DESC, prio) AS r FROM found),
sweep AS (SELECT {columns}, r, entity_type, value, s, n, true AS keep, s + n AS held FROM ordered WHERE r = 1
  UNION ALL SELECT {", ".join("o." + c.strip() for c in columns.split(","))}, o.r, o.entity_type, o.value, o.s, o.n, o.s >= w.held, CASE WHEN o.s >= w.held THEN o.s + o.n ELSE w.held END
  FROM sweep w JOIN ordered o ON o.doc_id = w.doc_id AND o.r = w.r + 1)
"""


_ROWS = "SELECT doc_id, entity_type, value, s AS start_byte, s + n AS end_byte FROM sweep WHERE keep"


def _stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) > {len(s) + 2} THEN {w}[1:length({w}) - {len(s)}]" for s in SUFFIXES) + f" ELSE {w} END"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _stripped(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^#+\s+', '', 'gm'), '[*`_>]', '', 'g')"


def _sent(t: str) -> str:
    return f"sent AS (SELECT doc_id, i - 1 AS idx, s[i] AS s, len(s) AS n FROM (SELECT doc_id, {_sentences(t)} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))"


_SENT = _sent(_stripped("text"))
_TERM = f"term AS (SELECT doc_id, idx, p, {_stem('w')} AS term FROM (SELECT doc_id, idx, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, idx, string_split_regex(lower(s), '[^a-z0-9]+') AS w FROM sent)) WHERE length(w) > 2 AND w NOT IN ({_STOP}))"
_TF = "tf AS (SELECT doc_id, idx, term, count(*) AS tf FROM term GROUP BY ALL)"

_CHUNK = rf"round({_words('t')} * 1.3::DOUBLE)::BIGINT AS token_estimate"
_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_TITLE_CASE = r"array_to_string(list_transform(regexp_extract_all({k}, '[^\s_-]+|[\s_-]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '')"
_VALID = r"({k} <> '' AND strlen({k}) <= 40 AND NOT regexp_matches({k}, '[.,]$') AND NOT contains({k}, '://') AND NOT contains({k}, '@') AND regexp_matches({k}, '^\pL'))"



def _walk(t: str = _stripped("text")) -> str:
    """Scores of the sentences of each document's text t: sixty rounds over the graph of their cosines."""
    return f"""{_sent(t)}, {_TERM}, {_TF}, mag AS (SELECT doc_id, idx, sqrt(sum(tf * tf)) AS mag FROM tf GROUP BY ALL),
sim AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, sum(a.tf * b.tf) / (any_value(x.mag) * any_value(y.mag)) AS w FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.term = b.term AND a.idx <> b.idx
  JOIN mag x ON x.doc_id = a.doc_id AND x.idx = a.idx JOIN mag y ON y.doc_id = b.doc_id AND y.idx = b.idx GROUP BY a.doc_id, a.idx, b.idx),
edge AS (SELECT doc_id, i, j, w / sum(w) OVER (PARTITION BY doc_id, i) AS w FROM sim UNION ALL SELECT doc_id, idx, idx, 0 FROM sent),
walk AS (SELECT 0 AS it, doc_id, idx AS j, 1.0::DOUBLE / n AS score, n FROM sent
  UNION ALL SELECT w.it + 1, e.doc_id, e.j, any_value((1 - 0.85::DOUBLE) / w.n) + sum(0.85::DOUBLE * e.w * w.score), any_value(w.n) FROM walk w JOIN edge e ON e.doc_id = w.doc_id AND e.i = w.j WHERE w.it < 60 GROUP BY w.it, e.doc_id, e.j)"""


_SCORED = f"""scored AS (SELECT s.doc_id, s.idx, s.s, s.n, {_words("s.s")}::BIGINT AS w, k.score, max(k.score) OVER d AS top, min(round(k.score, 9)) OVER d = max(round(k.score, 9)) OVER d AS level
  FROM sent s JOIN walk k ON k.it = 60 AND k.doc_id = s.doc_id AND k.j = s.idx WINDOW d AS (PARTITION BY s.doc_id))"""


def _made(level: str) -> str:
    """Common tables up to made: of each document what a reduction at the level tells; compressed is its shorter summary."""
    ratio, points, keys = LEVELS[level]
    return rf"""
picked_{level} AS (SELECT *, trim(regexp_replace(regexp_replace(s, '(?i)\b(?:{"|".join(FILLERS)})\b,?\s*', '', 'g'), '\s+', ' ', 'g')) AS short FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS r FROM scored WHERE w >= 4 OR level)
  WHERE r <= greatest(1, floor(n * {ratio}::DOUBLE + 0.5))),
chosen_{level} AS (SELECT doc_id, string_agg(s, ' ' ORDER BY idx) AS summary, coalesce(string_agg(short, ' ' ORDER BY idx) FILTER ((held <= most OR r = 1) AND short <> ''), '') AS compressed
  FROM (SELECT *, sum({_words("short")}) OVER (PARTITION BY doc_id ORDER BY r) AS held, ceil(sum(w) OVER (PARTITION BY doc_id) * {max(ratio, 0.5)}::DOUBLE) AS most FROM picked_{level}) GROUP BY doc_id),
point_{level} AS (SELECT doc_id, string_agg(s, ' / ' ORDER BY idx) AS key_points, string_agg('- ' || s, chr(10) ORDER BY idx) AS listed, count(*) AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.7::DOUBLE * score / greatest(1e-9, top) + 0.3::DOUBLE * (1 - idx::DOUBLE / n), 9) DESC, idx) AS r FROM scored WHERE w >= 4)
  WHERE r <= {points} GROUP BY doc_id),
word_{level} AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS r FROM total) WHERE r <= {keys} GROUP BY doc_id),
made_{level} AS (SELECT doc_id, text, nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), '') AS title, nullif(trim(string_split(text, chr(10))[1]), '') AS first_line, coalesce(summary, '') AS summary, coalesce(compressed, '') AS compressed, coalesce(key_points, '') AS key_points, listed, coalesce(n_points, 0) AS n_points, coalesce(keywords, '') AS keywords, coalesce(original_words, 0) AS original_words, coalesce(original_sentences, 0) AS original_sentences
  FROM documents LEFT JOIN chosen_{level} USING (doc_id) LEFT JOIN point_{level} USING (doc_id) LEFT JOIN word_{level} USING (doc_id) LEFT JOIN size USING (doc_id))"""


_TOTALS = "total AS (SELECT doc_id, term, count(*) AS c, min(idx * 1000000 + p) AS first FROM term GROUP BY ALL), size AS (SELECT doc_id, sum(w)::BIGINT AS original_words, count(*) AS original_sentences FROM scored GROUP BY doc_id)"


def _reduction(*levels: str) -> str:
    return f"WITH RECURSIVE {_walk()}, {_SCORED}, {_TOTALS}, {', '.join(map(_made, levels))}"


def _percent(summary: str) -> str:
    return f"round(CASE WHEN original_words > 0 THEN (1 - {_words(summary)}::DOUBLE / original_words) * 100 ELSE 0 END, 6) AS reduction_percent"


def _reduce(level: str) -> str:
    return f"{_reduction(level)} SELECT doc_id, title, summary, key_points, keywords, original_words, original_sentences, {_words('summary')}::BIGINT AS reduced_words, {_percent('summary')} FROM made_{level}"


def _tokens(words: str) -> str:
    return f"round(({words}) * 1.3::DOUBLE)::BIGINT"


# What may end a sentence: a line end, or a stop with closing marks and spaces behind it and a line end.
_STOP_RUN = r"""\r\n|[\n\r\x{85}\x{2028}\x{2029}]|[.!?]["'()\[\]{}«»‘’“”„‹›]*[ \t\x{A0}]*(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?"""


def _sentence_chunks(most: int) -> str:
    """Parts up to each place where a sentence may end; a part that goes on is one sentence with those behind it."""
    run = _STOP_RUN.replace("'", "''")
    return rf"""
WITH RECURSIVE raw AS (SELECT doc_id, regexp_extract_all(text, '{run}') AS m, string_split(regexp_replace(text, '{run}', chr(1), 'g'), chr(1)) AS g FROM documents),
part AS (SELECT doc_id, i, g[i] || coalesce(m[i], '') AS t, coalesce(g[i], '') AS before, coalesce(m[i], '') AS stop, coalesce(g[i+1], '') AS after, coalesce(g[i+1], '') || coalesce(m[i+1], '') AS next,
  (coalesce(list_sum(list_transform(g[1:i-1], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0))::BIGINT AS pos FROM raw, unnest(range(1, len(g) + 1)) AS u(i)),
ends AS (SELECT *, stop <> '' AND (regexp_matches(stop, '[\n\r\x{{85}}\x{{2028}}\x{{2029}}]$') OR NOT (regexp_matches(next, '^[.!?,:;–—-]') OR (starts_with(stop, '.') AND (regexp_matches(after, '^[^\pL]*\p{{Ll}}')
  OR (stop = '.' AND (regexp_matches(next, '^\p{{Nd}}') OR (regexp_matches(before, '[\p{{Lu}}\p{{Ll}}]$') AND regexp_matches(next, '^\p{{Lu}}')))))))) AS over FROM part),
span AS (SELECT doc_id, k AS i, string_agg(t, '' ORDER BY i) AS t, min(pos) AS begin FROM (SELECT *, coalesce(sum(over::BIGINT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends) GROUP BY doc_id, k),
one AS (SELECT doc_id, t, begin, {_tokens(_words("t"))} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM span WHERE regexp_matches(t, '[\pL\pN]')),
fold AS (SELECT doc_id, r, n AS held, 0::BIGINT AS c FROM one WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN f.held + o.n > {most} THEN o.n ELSE f.held + o.n END, f.c + (f.held + o.n > {most})::BIGINT FROM fold f JOIN one o ON o.doc_id = f.doc_id AND o.r = f.r + 1),
t AS (SELECT doc_id, c, {_TRIMMED.format("string_agg(t, ' ' ORDER BY r)")} AS t, min(begin) AS start_offset FROM fold JOIN one USING (doc_id, r) GROUP BY doc_id, c)
SELECT doc_id, t AS text, c AS idx, start_offset, {_CHUNK} FROM t"""


def _recursive_chunks(separators: tuple[str, ...], most: int) -> str:
    made = "SELECT doc_id, text AS t, 0::BIGINT AS pos, [0::BIGINT] AS place FROM documents"
    for sep in separators:
        text = " || ".join(f"chr({ord(c)})" for c in sep)
        split = f"SELECT doc_id, p[i] AS t, (pos + coalesce(list_sum(list_transform(p[1:i-1], lambda x: strlen(x) + {len(sep)})), 0))::BIGINT AS pos, list_append(place, i) AS place FROM (SELECT *, string_split(t, {text}) AS p FROM x WHERE {_tokens(_words('t'))} > {most}), unnest(range(1, len(p) + 1)) AS u(i)"
        made = f"WITH x AS ({made}) SELECT doc_id, t, pos, list_append(place, 0::BIGINT) AS place FROM x WHERE {_tokens(_words('t'))} <= {most} UNION ALL {split}"
    return rf"""
WITH RECURSIVE part AS ({made}), one AS (SELECT doc_id, t, pos, {_words("t")} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM part),
fold AS (SELECT doc_id, r, w AS held, t <> '' AS begun, 0::BIGINT AS c FROM one WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN cut THEN o.w ELSE f.held + o.w END, CASE WHEN cut THEN o.t <> '' ELSE f.begun OR o.t <> '' END, f.c + cut::BIGINT
  FROM fold f JOIN one o ON o.doc_id = f.doc_id AND o.r = f.r + 1, LATERAL (SELECT f.begun AND {_tokens("f.held + o.w")} > {most} AS cut)),
t AS (SELECT doc_id, c, {_TRIMMED.format("string_agg(t, ' ' ORDER BY r)")} AS t, min(pos) FILTER (t <> '') AS start_offset FROM fold JOIN one USING (doc_id, r) GROUP BY doc_id, c)
SELECT doc_id, t AS text, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS idx, start_offset, {_CHUNK} FROM t WHERE t <> ''"""


def _embedded(source: str, key: str, text: str) -> str:
    """Common tables: (key, bucket, x) of the places of hash vectors that aren't zero, in single precision."""
    n = source
    return rf"""{n}_w AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '[^\pL\pN]+'), lambda x: strlen(x) > 1)) AS w FROM {source}),
{n}_d AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM {n}_w),
{n}_h AS (SELECT w, list_reduce(list_transform(range(0, (length(x) // 2)), lambda i: ('0x' || x[2*i+1:2*i+2])::UHUGEINT), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM {n}_d),
{n}_s AS (SELECT {key}, (h % 256)::BIGINT AS bucket, sum(CASE WHEN (h // 4294967296::UHUGEINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM {n}_w JOIN {n}_h USING (w) GROUP BY ALL),
{n}_x AS (SELECT {key}, bucket, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {n}_s QUALIFY s <> 0)"""


_RETRIEVED = f"""
WITH win AS (SELECT doc_id, k, text[k*1200+1:k*1200+1200] AS w, strlen(text[1:k*1200])::BIGINT AS start_offset FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text) / 1200.0)::BIGINT END)) AS u(k)),
chunk AS (SELECT doc_id, t, start_offset, doc_id * 16777216 + row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS vec_id FROM (SELECT *, {_TRIMMED.format("w")} AS t FROM win) WHERE t <> ''),
{_embedded("chunk", "vec_id", "t")}, {_embedded("benchmark", "item_id", "text")},
long_c AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM chunk_x GROUP BY ALL), long_q AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM benchmark_x GROUP BY ALL),
score AS (SELECT q.item_id AS query_id, c.vec_id, sum(q.x * c.x / a.n / b.n) AS score FROM benchmark_x q JOIN chunk_x c USING (bucket) JOIN long_q a ON a.item_id = q.item_id JOIN long_c b ON b.vec_id = c.vec_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM score QUALIFY rank <= 4),
source AS (SELECT query_id, rank, doc_id, start_offset, score, t, sum(strlen(t)) OVER (PARTITION BY query_id ORDER BY rank) AS held FROM ranked JOIN chunk USING (vec_id))"""


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ANSWER = f"{_quoted(FOUND[0])} || n_sources || {_quoted(FOUND[1])} || question || {_quoted(FOUND[2])} || lines || {_quoted(FOUND[3])}"

_MMR = """
WITH RECURSIVE p AS (SELECT q.vec_id AS query_id, e.vec_id, e.embedding::DOUBLE[] AS v, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM p QUALIFY rank <= 8),
near AS (SELECT a.query_id, a.rank, a.vec_id, a.score, list(list_cosine_similarity(a.v, b.v) ORDER BY b.rank) AS sims FROM c a JOIN c b USING (query_id) GROUP BY ALL),
pick AS (SELECT query_id, 0 AS step, []::BIGINT[] AS taken FROM near GROUP BY query_id
  UNION ALL SELECT p.query_id, any_value(p.step) + 1, list_append(any_value(p.taken), list(n.rank ORDER BY round(0.5::DOUBLE * n.score - 0.5::DOUBLE * greatest(0, coalesce(list_max(list_transform(p.taken, lambda t: n.sims[t])), 0)), 12) DESC, n.rank)[1])
  FROM pick p JOIN near n ON n.query_id = p.query_id AND NOT list_contains(p.taken, n.rank) GROUP BY p.query_id)
SELECT query_id, vec_id, round(score, 6) AS score, step::BIGINT AS rank FROM (SELECT query_id, step, taken[step] AS r FROM pick WHERE step > 0) JOIN near USING (query_id) WHERE near.rank = r"""


def _markdown() -> str:
    clean = r"trim(regexp_replace(l[i], '[^\pL\pN .,]', '', 'g'))"
    return rf"""
WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, 0 AS section, 0 AS idx, 'heading' AS kind, 1 AS level, 'Document ' || doc_id AS text FROM l
  UNION ALL SELECT doc_id, 0, i, 'paragraph', NULL, trim('P ' || {clean}) || ' of line ' || (i - 1) FROM l, unnest(range(1, len(l) + 1)) AS u(i)
  UNION ALL SELECT doc_id, 1, unnest([0, 1, 2, 3, 4]), unnest(['heading', 'list', 'quote', 'code', 'plain']), unnest([2, NULL, NULL, NULL, NULL]), unnest(['Notes of it', lang || ' / ' || source, 'quoted words of two lines', 'SELECT 1' || chr(10) || chr(10) || 'FROM x', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |']) FROM l)
SELECT doc_id, 'Document ' || doc_id AS title, section::BIGINT AS section, idx::BIGINT AS idx, kind, coalesce(level, 0)::BIGINT AS level, text FROM b"""


def _html() -> str:
    plain = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""
    return rf"""
WITH p AS (SELECT page_id, {plain.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul>', 1, 's'), '<li>(.*?)</li>', 1, 's') AS items,
  regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
q AS (SELECT *, regexp_extract(body, '<h1>(.*?)</h1>', 1, 's') AS h, string_split(regexp_extract(body, '</h1>(.*)$', 1, 's'), '<p>')[2:] AS ps FROM p),
b AS (SELECT page_id, title, 0 AS pos, 'list' AS kind, NULL AS level, array_to_string(list_filter(list_transform(items, lambda x: {plain.format("x")}), lambda x: x <> ''), ' / ') AS text FROM q
  UNION ALL SELECT page_id, title, 1, 'heading', 1, {plain.format("h")} FROM q UNION ALL SELECT page_id, title, 1 + i, 'paragraph', NULL, {plain.format("ps[i]")} FROM q, unnest(range(1, len(ps) + 1)) AS u(i))
SELECT page_id AS doc_id, title, 0::BIGINT AS section, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx, kind, coalesce(level, 0)::BIGINT AS level, text FROM b WHERE text <> ''"""


def _detected() -> str:
    begun = lambda b: "'' || " + " || ".join(f"chr({ord(c)})" if c in "\n\t\x03\x04" else f"'{c}'" for c in b)
    kinds = {"pdf": "'pdf'", "zip": "'docx'", "epub": "'epub'", "blank": "'html'", "tag": "'html'", "list": "'markdown'"}
    made = " UNION ALL ".join(f"SELECT '{src}', doc_id, {kinds[src]} FROM documents WHERE {begun(b)} || text IS NOT NULL" for src, b in BEGINNINGS)
    return f"""SELECT 'documents' AS src, doc_id AS id, {_format("text")} AS format FROM documents UNION ALL SELECT 'pages', page_id, {_format("html")} FROM pages UNION ALL SELECT 'markdown', doc_id, 'markdown' FROM documents UNION ALL {made}"""


ORACLES = {
    "q_detect_format": f"""SELECT 'documents' AS src, doc_id AS id, {_format("text")} AS format FROM documents UNION ALL SELECT 'pages', page_id, {_format("html")} FROM pages
      UNION ALL SELECT 'markdown', doc_id, 'markdown' FROM documents""",
    "q_detect_bytes": f"SELECT *, 'html' AS hinted, format AS unhinted FROM ({_detected()})",
    "q_parse_errors": f"SELECT src, id, format, format IN ('pdf', 'docx') AS failed, (format NOT IN ('pdf', 'docx'))::BIGINT AS sections FROM ({_detected()}) WHERE src IN ('documents', 'pdf', 'zip')",
    "q_doc_stats": f"SELECT doc_id, {_words('text')}::BIGINT AS words, len({_sentences('text')})::BIGINT AS sentences, length(text) AS chars, strlen(text) AS bytes FROM documents",
    "q_sentences": f"SELECT doc_id, (i - 1)::BIGINT AS idx, s[i] AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)",
    "q_token_estimate": f"SELECT lang, sum(round({_words('text')} * 1.3::DOUBLE))::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY lang",
    "q_entities": _entities("SELECT doc_id, text FROM documents", "doc_id") + _ROWS,
    "q_entity_counts_by_lang": _entities("SELECT doc_id, lang, text FROM documents", "doc_id, lang") + "SELECT lang, entity_type, count(*) AS n FROM sweep WHERE keep GROUP BY ALL",
    "q_invoice_entities": _entities(INVOICES_SQL, "doc_id") + _ROWS,
    "q_key_values": f"""
WITH lines AS (SELECT doc_id, j, trim(l[j]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({INVOICES_SQL})), unnest(range(1, len(l) + 1)) AS u(j)),
parts AS (SELECT *, strpos(line, ':') AS c, length(regexp_extract(line, '^(.*?)  +', 1)) AS gap FROM lines),
cut AS (SELECT *, trim(line[1:c-1]) AS k, trim(line[c+1:]) AS v, trim(line[1:gap]) AS ak, trim(line[gap+1:]) AS av FROM parts),
field AS (SELECT doc_id, j, CASE WHEN c > 0 AND {_VALID.format(k="k")} AND v <> '' AND length(v) - length(replace(v, '.', '')) <= 2 THEN {{'k': {_TITLE_CASE.format(k="k")}, 'v': v, 'c': 0.9::DOUBLE}}
  WHEN gap > 0 AND {_VALID.format(k="ak")} AND av <> '' AND strlen(av) <= 100 AND len(string_split_regex(ak, '\\s+')) <= 4 THEN {{'k': {_TITLE_CASE.format(k="ak")}, 'v': av, 'c': 0.75::DOUBLE}} END AS f FROM cut)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS idx, f.k AS key, f.v AS value, f.c AS confidence FROM field WHERE f IS NOT NULL""",
    "q_tables": """
SELECT l_orderkey AS doc_id, count(*) + 1 AS n_rows, 3::BIGINT AS n_columns, true AS has_header, 2::BIGINT AS start_line, 'line,part,qty' AS header,
 string_agg(l_linenumber::VARCHAR || ',' || l_partkey::VARCHAR || ',' || l_quantity::BIGINT::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, l_quantity::BIGINT) AS cells FROM lineitem GROUP BY l_orderkey""",
    "q_term_freq": f"WITH {_SENT}, {_TERM}, {_TF} SELECT doc_id, idx::BIGINT AS idx, term, tf FROM tf",
    "q_textrank": f"""
WITH RECURSIVE {_walk()}
SELECT doc_id, j::BIGINT AS idx, round(score, 6) AS score FROM walk WHERE it = 60""",
    "q_keywords": f"""
WITH {_SENT}, {_TERM}, total AS (SELECT doc_id, term, count(*) AS n, min(idx * 1000000 + p) AS first FROM term GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1 AS pos FROM total) SELECT doc_id, pos, term AS keyword FROM best WHERE pos < 8""",
    "q_chunk_fixed": f"""
WITH c AS (SELECT doc_id, text[k*700+1:k*700+800] AS w, strlen(text[1:k*700])::BIGINT AS start_offset, k FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1 ELSE 1 + ceil((length(text) - 800) / 700.0)::BIGINT END)) AS u(k)),
t AS (SELECT doc_id, start_offset, k, {_TRIMMED.format("w")} AS t FROM c)
SELECT doc_id, t AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, start_offset, {_CHUNK} FROM t WHERE t <> ''""",
    "q_chunk_paragraph": f"""
WITH p AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM p),
t AS (SELECT doc_id, {_TRIMMED.format("l[i]")} AS t, i - 1 AS idx, (coalesce(list_sum(list_transform(l[1:i-1], lambda x: strlen(x))), 0) + 2 * (i - 1))::BIGINT AS start_offset FROM s, unnest(range(1, len(l) + 1)) AS u(i))
SELECT doc_id, t AS text, idx::BIGINT AS idx, start_offset, {_CHUNK} FROM t WHERE t <> ''""",
    "q_hash_embed": f"WITH {_embedded('documents', 'doc_id', 'text')} SELECT doc_id, bucket, round(x, 5) AS value FROM documents_x",
    "q_vector_topk": """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "q_l2": "SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS distance, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q ON e.label IS NOT DISTINCT FROM q.label",
    "q_fillers": f"SELECT doc_id, {_without_fillers("'Basically, in order to see: ' || text")} AS text FROM documents",
    "q_reduction_metrics": f"""
WITH m AS (SELECT lang, {_words("text")} AS o, {_words(_without_fillers("text"))} AS r FROM documents)
SELECT lang, sum(o)::BIGINT AS original_words, sum(r)::BIGINT AS reduced_words, round(avg(CASE WHEN o > 0 THEN (1 - r::DOUBLE / o) * 100 ELSE 0 END), 6) AS reduction_percent FROM m GROUP BY lang""",
    "q_rate_limit": """
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, epoch(ts)::BIGINT - epoch(ts)::BIGINT % 3600 ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, count(*) AS requests, sum((n <= 2)::BIGINT)::BIGINT AS allowed FROM r GROUP BY user_id""",
    "q_rbac": "SELECT user_id::VARCHAR AS actor, count(*) AS actions, max(floor(epoch(ts)))::BIGINT AS last FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) GROUP BY user_id",
    "q_audit": "SELECT event_type AS action, count(*) AS n, min(floor(epoch(ts)))::BIGINT AS first FROM events GROUP BY event_type",
}
_DONE = f"{_words('compressed')}::BIGINT AS reduced_words"

ORACLES |= {
    "q_reduce_light": _reduce("light"),
    "q_reduce_basic": _reduce("medium"),
    "q_reduce_aggressive": _reduce("aggressive"),
    "q_reduce_full": f"""{_reduction("medium")}
SELECT doc_id, 'plaintext' AS format, coalesce(first_line, title) AS title, trim(CASE WHEN n_points > 0 THEN compressed || chr(10) || chr(10) || '**Key points**' || chr(10) || chr(10) || listed ELSE compressed END) AS output, original_words, {_DONE},
 round(CASE WHEN original_words > 0 THEN {_words("compressed")}::DOUBLE / original_words ELSE 0 END, 6) AS retention_ratio, NULL::VARCHAR AS error FROM made_medium""",
    "q_reduce_levels": _reduction(*LEVELS) + " UNION ALL ".join(f" SELECT doc_id, '{x}' AS level, compressed AS summary, keywords, original_sentences, n_points AS key_points, {_percent('compressed')} FROM made_{x}" for x in LEVELS),
    "q_compress": f"""
WITH RECURSIVE {_walk(_without_fillers("text"))}, w AS (SELECT doc_id, ceil({_words("text")} * 0.4::DOUBLE) AS most FROM documents),
one AS (SELECT s.doc_id, s.idx, s.s, row_number() OVER d AS r, sum({_words("s.s")}) OVER d AS held FROM sent s JOIN walk k ON k.it = 60 AND k.doc_id = s.doc_id AND k.j = s.idx WINDOW d AS (PARTITION BY s.doc_id ORDER BY round(k.score, 9) DESC, s.idx))
SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY idx) FILTER (held <= most OR r = 1), '') AS text FROM w LEFT JOIN one USING (doc_id) GROUP BY doc_id""",
    "q_render": f"""{_reduction("medium")}
SELECT doc_id, CASE WHEN n_points > 0 THEN summary || chr(10) || chr(10) || 'Key points:' || chr(10) || listed || chr(10) ELSE summary END AS plaintext,
 trim(CASE WHEN n_points > 0 THEN summary || chr(10) || chr(10) || '**Key points**' || chr(10) || chr(10) || listed ELSE summary END) AS markdown, summary AS json,
 '# ' || coalesce(title, 'Summary') || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## Key points' || chr(10) || coalesce(listed, '') AS page FROM made_medium""",
    "q_progress_events": f"""{_reduction("medium")}
SELECT doc_id, seq::BIGINT AS seq, ['started', 'detected', 'parsed', 'summarized', 'done'][seq + 1] AS phase, CASE WHEN seq = 0 THEN strlen(text) ELSE -1 END AS total_bytes, CASE WHEN seq = 1 THEN {_format("text")} END AS format, CASE WHEN seq = 2 THEN 1::BIGINT ELSE -1 END AS sections,
 CASE WHEN seq = 2 THEN {_words("text")}::BIGINT ELSE -1 END AS words, CASE WHEN seq = 3 THEN original_sentences ELSE -1 END AS sentences, CASE WHEN seq = 3 THEN n_points ELSE -1 END AS key_points, CASE WHEN seq = 4 THEN compressed END AS summary, NULL::VARCHAR AS message FROM made_medium, range(5) AS u(seq)""",
    "q_stream_results": f"""{_reduction("medium")}
SELECT doc_id, coalesce(first_line, title) AS title, 'plaintext' AS source_format, compressed AS summary, keywords, original_words, {_DONE}, NULL::VARCHAR AS error FROM made_medium""",
    "q_unlimited": "SELECT true AS allowed, count(*) AS n FROM events",
    "q_chunk_sentence": _sentence_chunks(100),
    "q_chunk_semantic": _sentence_chunks(200),
    "q_chunk_recursive": _recursive_chunks(("\n", ". "), 120),
    "q_mmr": _MMR,
    "q_rag_sources": f"{_RETRIEVED} SELECT query_id, rank, doc_id, start_offset, round(score, 6) AS score, t AS text FROM source WHERE held <= 4000",
    "q_rag_answer": f"""{_RETRIEVED}
SELECT query_id, n_sources, {_ANSWER} AS answer FROM (SELECT query_id, count(*) FILTER (held <= 4000)::INTEGER AS n_sources, coalesce(string_agg('[' || rank || '] ' || t || chr(10), '' ORDER BY rank) FILTER (held <= 4000), '') AS lines FROM source GROUP BY query_id)
JOIN (SELECT item_id AS query_id, text AS question FROM benchmark) USING (query_id)""",
    "q_parse_markdown": _markdown(),
    "q_parse_html": _html(),
    "q_parse_plain": r"""
WITH p AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM p)
SELECT doc_id, nullif(regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g'), '') AS title, greatest(1, len(l))::BIGINT AS n_blocks, array_to_string(l, chr(10) || chr(10)) AS text FROM l""",
    "q_field_value": f"""
SELECT doc_id, '$' || (floor(o_totalprice)::BIGINT % 1000)::VARCHAR || '.00' AS total, c_name AS customer, NULL::VARCHAR AS none FROM ({INVOICES_SQL}) i JOIN orders ON o_orderkey = i.doc_id JOIN customer ON o_custkey = c_custkey""",
    "q_extract": f"""
SELECT doc_id, 0::BIGINT AS n_tables, coalesce(k.f, '') AS fields, coalesce(e.f, '') AS entities, (coalesce(k.n, 0) + coalesce(e.n, 0))::BIGINT AS field_count, 1.0::DOUBLE AS confidence, 'heuristic' AS provider FROM ({INVOICES_SQL})
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(key || '=' || value || '=' || round(confidence * 100)::INTEGER, ';' ORDER BY idx) AS f FROM ({ORACLES["q_key_values"]}) GROUP BY doc_id) k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(entity_type || ':' || value || ':' || start_byte || ':' || end_byte, ';' ORDER BY start_byte) AS f FROM ({ORACLES["q_invoice_entities"]}) GROUP BY doc_id) e USING (doc_id)""",
}
