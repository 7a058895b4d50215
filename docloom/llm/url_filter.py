"""URL filter with redirect equivalence, in DataFrame functions only.

Rules judge a page by its host and path. Pages that redirect to each other, or name the same canonical URL, are one page
under several names: connected components over these edges carry a block from one name to its aliases. An explicit allow,
of the page itself or of any alias, comes before a block that only an alias has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.tables import scratch, written
from docloom.llm.urls import host_of, node_of, path_of

#: Rules up to this number are tested as one expression in the scan; more would make it too large.
MOST_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def _chosen(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, allow before block among equals; null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(pick)
    return pick


# Named character references that URLs in attributes need; &amp; is read last.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&sol;", "/"), ("&quest;", "?"), ("&num;", "#"), ("&equals;", "="), ("&colon;", ":"), ("&period;", "."), ("&amp;", "&"))


def _decoded(value: Column) -> Column:
    """value with its numeric and the most common named character references read."""

    def number(m: Column) -> Column:
        digits = F.regexp_extract(m, r"&#[xX]?([0-9A-Fa-f]+)", 1)
        code = F.when(m.rlike("^&#[xX]"), F.conv(digits, 16, 10)).when(digits.rlike("^[0-9]+$"), digits).otherwise("65533").cast("decimal(38,0)")
        known = (code > 0) & (code < 0x110000) & ~((code >= 0xD800) & (code < 0xE000))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")

    # cut at the references, so that what one of them gives isn't read again
    pattern = r"&#[xX]?[0-9A-Fa-f]{1,9};"
    out = F.array_join(F.transform(F.arrays_zip(F.split(value, pattern, -1).alias("a"), F.concat(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.array(F.lit(""))).alias("b")), lambda p: F.concat(_named(p["a"]), F.when(p["b"] == "", "").otherwise(number(p["b"])))), "")
    return F.when(F.instr(value, "&") > 0, out).otherwise(value)


def _named(value: Column) -> Column:
    for name, by in _REFERENCES:
        value = F.replace(value, F.lit(name), F.lit(by))
    return value


def _without_dots(path: Column) -> Column:
    """A path that begins with /, its . and .. segments followed."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    none = F.array().cast("array<string>")

    def step(out: Column, s: Column) -> Column:
        return F.when(s == ".", out).when(s == "..", F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(none)).otherwise(F.concat(out, F.array(s)))

    done = F.aggregate(parts, none, step)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(done) > 0)
    walked = F.concat(F.lit("/"), F.array_join(done, "/"), F.when(folder, "/").otherwise(""))
    return F.when(F.contains(path, F.lit("/.")), walked).otherwise(path)


def resolved(links: DataFrame) -> DataFrame:
    """links(base, target), and what else it has, with url: the absolute URL of target as a link on the page base, without
    its fragment; null where that isn't an http(s) URL. Each step is a column of its own, so expressions stay small."""
    base = F.col("base")
    bare = F.regexp_extract("target", r"(?s)^[\x00-\x20]*([^#]*?)[\x00-\x20]*(#.*)?$", 1)
    scheme = F.lower(F.regexp_extract(base, r"(?i)^(https?)://", 1))
    links = links.withColumns({"bare": bare, "scheme": scheme, "host": host_of(base), "path": path_of(base)})
    site = F.concat("scheme", F.lit("://"), "host")
    folder = F.when(F.col("path") == "", "/").otherwise(F.regexp_extract("path", r"^(.*/)", 1))
    bare = F.col("bare")
    whole = (
        F.when(bare.rlike(r"(?i)^https?://"), bare)
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.col("scheme") == ""), F.lit(None).cast("string"))
        .when(bare.startswith("//"), F.concat("scheme", F.lit(":"), bare))
        .when(bare == "", base)
        .when(bare.startswith("/"), F.concat(site, bare))
        .when(bare.startswith("?"), F.concat(site, F.col("path"), bare))
        .otherwise(F.concat(site, folder, bare))
    )
    links = links.withColumn("whole", whole)
    query = F.regexp_extract("whole", r"(?s)^[^?#]*(\?[^#]*)?", 1)
    links = links.withColumns({"scheme": F.lower(F.regexp_extract("whole", r"^([A-Za-z]+)://", 1)), "host": host_of(F.col("whole")), "path": path_of(F.col("whole")), "query": query})
    links = links.withColumn("path", _without_dots(F.when(F.col("path") == "", "/").otherwise(F.col("path"))))
    url = F.when(F.col("whole").isNotNull(), F.concat("scheme", F.lit("://"), "host", "path", "query"))
    return links.withColumn("url", url).drop("bare", "whole", "scheme", "host", "path", "query")


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): names of pages that stand for the same page, from canonical links and refresh redirects in the html.

    Comments, scripts and styles hold no links. Targets have their character references decoded and are read against the
    page's URL, or the page's base element where that is an http(s) URL; what isn't an http(s) URL then gives no edge.
    """

    def attribute(tag: Column, name: str) -> Column:
        found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\"'\s>]+)", 1)
        return F.regexp_replace(found, "^[\"']|[\"']$", "")

    def tags(name: str, key: str, value: str) -> Column:
        every = F.regexp_extract_all("markup", F.lit(rf"(?is)<{name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
        return F.filter(every, lambda t: F.lower(attribute(t, key)).rlike(value))

    some = pages.filter(F.col("html").rlike("(?i)canonical|http-equiv"))
    markup = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|noscript|template)\b.*?(?:</\1\b[^>]*>|\z)", " ")
    seen = some.select(F.col("url").alias("page"), markup.alias("markup"))
    seen = seen.select("page", tags("link", "rel", r"(^|\s)canonical(\s|$)").alias("links"), tags("meta", "http-equiv", r"^\s*refresh\s*$").alias("metas"), tags("base", "href", ".").alias("bases"))
    refresh = F.transform("metas", lambda t: F.regexp_replace(F.regexp_extract(attribute(t, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1), r"^(['\"])(.*?)\1.*$", "$2"))
    targets = F.filter(F.concat(F.transform("links", lambda t: attribute(t, "href")), refresh), lambda t: t != "")
    named = F.get(F.filter(F.transform("bases", lambda t: _decoded(attribute(t, "href"))), lambda b: b.rlike("(?i)^https?://")), F.lit(0))
    found = seen.select("page", named.alias("named"), F.explode(targets).alias("raw"))
    found = found.select("page", F.coalesce("named", "page").alias("base"), _decoded(F.col("raw")).alias("target"))
    names = resolved(found).select(node_of(F.col("page")).alias("a"), node_of(F.col("url")).alias("b"))
    # a filter would be pushed through all these steps, and repeat their expressions
    return names.select(F.inline(F.filter(F.array(F.struct("a", "b")), lambda e: e["a"] != e["b"])))


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = DEFAULT_RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (of the longest rule that fits, or null), verdict.

    verdict: the rule's; without a rule, allow if an alias is allowed, else block if an alias is blocked, else allow.
    redirects: more edges, columns a and b with URLs. A null url has an empty host and path, no rule and verdict allow.
    Repeated pages are judged each; other columns are ignored; a table without links needs no shuffle, an empty one gives an
    empty one.
    """
    url = F.col("url")
    pick = _chosen(host_of(url), path_of(url), rules)
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), pick.alias("pick"))
    edges = link_edges(pages) if "html" in pages.columns else None
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).filter("a is not null and b is not null")
        edges = more if edges is None else edges.union(more)
    own = F.col("pick.verdict")
    groups = None
    if edges is not None:
        with scratch():
            edges = written(edges.distinct(), "links")  # few: pages that name another address
            groups = None if edges.isEmpty() else written(components(edges), "aliases", keep=True)
    if groups is None:
        return judged.select("page_id", "host", "path", F.col("pick.rule").alias("rule"), F.coalesce(own, F.lit("allow")).alias("verdict"))
    # an alias needn't be a page of the table: rules judge it by its name
    named = F.concat(F.lit("http://"), F.col("node"))
    verdicts = (
        groups.select("component", _chosen(host_of(named), path_of(named), rules)["verdict"].alias("v"))
        .groupBy("component")
        .agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    )
    by_node = groups.join(verdicts, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
    return judged.join(by_node, "node", "left").select(
        "page_id", "host", "path", F.col("pick.rule").alias("rule"), F.coalesce(own, F.col("alias_verdict"), F.lit("allow")).alias("verdict")
    )
