"""Main text of web pages: markup rules, and differencing with the page of the nearest URL.

Pages are sorted by host and URL path, so that a page's neighbours share the longest paths and, as a rule, its template.
All lines of text of a page are aligned with those of its neighbours by longest common subsequence, and shared lines go:
they come from the template. Copies of an article under two URLs keep their text: what only copies share isn't template.
Markup is a further filter: where an element that marks a main part holds most of what is left, the rest goes too.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator, Set

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import by_batch
from docloom.llm.urls import host_of, path_of

# Elements by role.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea head dialog menu datalist audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split()
)
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark an element as no part of the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside "
    "comment comments commentlist discussion disqus replies menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social newsletter subscribe subscription signup login search "
    "related recommended pagination pager widget skip".split()
)
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


def _marked(token: str) -> bool:
    """Whether a class or an id is made up of marking words only, as cookie-notice is and with-sidebar isn't."""
    words = _WORDS.findall(token)
    return token.isascii() and bool(words) and all(w in MARKED for w in words)


def _unwanted(name: str, attributes: str, in_main: bool) -> int:
    """0: wanted, 1: unwanted by a class or id only, 2: unwanted."""
    if name in DROPPED or (name == "header" and not in_main):
        return 2
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in MARKED_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if key == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if key in ("class", "id") and name not in ("html", "body", *MAIN) and any(map(_marked, value.split())):
            found = 1
    return found


def _comment(attributes: str) -> bool:
    """Whether a class or id says that an element is a reader's comment."""
    return any(m[1].lower() in ("class", "id") and any(_WORDS.findall(t)[:1] in (["comment"], ["comments"]) for t in (m[2] or m[3] or m[4] or "").lower().split()) for m in _ATTRIBUTE.finditer(attributes))


def lines(page: str) -> list[tuple[str, bool]]:
    """Lines of text in page order, one for each block, and whether each stands inside a main part.

    A class or id drops no element that marks a main part or contains one; but behind the beginning of a main part,
    article elements that are comments by class or id are none, and are dropped.
    """
    around: set[int] = set()
    found = _lines(page, around, frozenset())
    return _lines(page, set(), around) if around else found


def _lines(page: str, around: set[int], spared: Set[int]) -> list[tuple[str, bool]]:
    """Lines as in lines(). Elements are known by where they begin; around takes those unwanted by class around a main
    part, and those in spared are wanted whatever their class."""
    by_class: list[tuple[int, int]] = []  # place in open_, begin
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # name, begins an unwanted part, begins a main part
    unwanted = main = 0
    at = 0
    any_main = False

    def shut_last() -> tuple[str, bool, bool]:
        if by_class and by_class[-1][0] == len(open_) - 1:
            by_class.pop()
        return open_.pop()

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, main > 0))

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if not unwanted and m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if any(x[0] == name for x in open_):
                if name in BLOCKS:
                    flush()
                while True:
                    shut, drops, mains = shut_last()
                    if drops or mains:
                        if not drops:
                            flush()
                        unwanted -= drops
                        main -= mains
                    if shut == name:
                        break
            continue
        if name in BLOCKS or name in DROPPED:
            flush()
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "option", "dt", "dd") and open_ and open_[-1][0] == name:
            _, drops, mains = shut_last()
            unwanted -= drops
            main -= mains
        comment = name == "article" and any_main and "comment" in m[3].lower() and _comment(m[3])
        why = 2 if comment else _unwanted(name, m[3], main > 0)
        drops = why == 2 or why == 1 and m.start() not in spared
        any_main |= name in MAIN and not drops and not unwanted
        if name in MAIN and not comment:
            around.update(begin for _, begin in by_class)
            by_class.clear()
        if drops and why == 1:
            by_class.append((len(open_), m.start()))
        mains = not drops and not unwanted and name in MAIN
        if drops and name not in BLOCKS:
            flush()
        open_.append((name, drops, mains))
        unwanted += drops
        main += mains
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if not unwanted and name != "title":
                text.append(page[at:stop])
            at = stop
    if not unwanted and at < len(page):
        text.append(page[at:])
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Indexes into a of a longest common subsequence of a and b."""
    low, end_a, end_b = 0, len(a), len(b)
    while low < min(end_a, end_b) and a[low] == b[low]:
        low += 1
    while end_a > low and end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    shared = set(a[low:end_a]) & set(b[low:end_b])
    x = [i for i in range(low, end_a) if a[i] in shared]
    number = {line: i for i, line in enumerate(shared)}
    return {*range(low), *range(end_a, len(a)), *(x[i] for i in aligned([number[a[i]] for i in x], [number[line] for line in b[low:end_b] if line in shared]))}


#: Bits of the table by which two lists are aligned at once; longer lists are halved first.
TABLE_BITS = 1 << 27


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of b, the places of a as bits: 0 where the longest common subsequence with a's prefix gets longer.

    One row of the usual table at a time, as a carry that runs through an integer (Hyyro, "Bit-parallel LCS-length
    computation revisited", 2004).
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of longest common subsequences of b with each prefix of a."""
    row = 0
    for row in _steps(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b; memory grows with the lists, not with their product."""
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) > TABLE_BITS:
        mid = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:mid]) + _lengths(a[::-1], b[:mid - 1 : -1])[::-1]))
        return aligned(a[:cut], b[:mid]) + [cut + i for i in aligned(a[cut:], b[mid:])]
    rows = list(_steps(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> i - 1 & 1:  # b's prefix without this line does not get as far
            i -= 1
            out.append(i)
    return out[::-1]


def kept_lines(found: list[tuple[str, bool]], near: list[list[tuple[str, bool]]], far: list[list[tuple[str, bool]]] = ()) -> list[int]:
    """Indexes of the lines that alignment leaves.

    near: the nearest other pages of the host, far: further ones, which only tell a copy from a template. Lines that all of
    these pages have tell nothing about copies (unless they are nine tenths of the text: then all pages are copies); a page
    with most of the others is a copy of this one, and what it shares goes only where a page that is no copy has it too.
    A single other page is a copy if it shares over half the text.
    """
    own = [line for line, _ in found]
    theirs = [[line for line, _ in x] for x in (*near, *far)]
    sets = [set(x) for x in theirs]
    rest = [x for x in own if not all(x in s for s in sets)]
    if len(sets) == 1 or 10 * sum(map(len, rest)) < sum(map(len, own)):
        rest = own
    size = sum(map(len, rest))
    copy = [2 * sum(len(x) for x in rest if x in s) > size for s in sets]
    gone: set[int] = set()
    for k in range(len(near)):
        shared = common(own, theirs[k])
        gone |= {i for i in shared if any(own[i] in s for s, c in zip(sets, copy, strict=True) if not c)} if copy[k] else shared
    return [i for i in range(len(own)) if i not in gone]


def main_text(found: list[tuple[str, bool]], near: list[list[tuple[str, bool]]], far: list[list[tuple[str, bool]]] = ()) -> str:
    """The main text of a page with the given lines, beside other pages of its host (see kept_lines).

    Of what alignment leaves, lines outside a marked main part go where the main part has most of the text.
    """
    kept = kept_lines(found, near, far)
    inside = sum(len(found[i][0]) for i in kept if found[i][1])
    marked = 2 * inside >= sum(len(found[i][0]) for i in kept) and inside > 0
    return " ".join(found[i][0] for i in kept if found[i][1] or not marked)


#: Distinct pages on either side that a page is compared with: the nearest is aligned, the others tell copies apart.
SIDE = 2
#: Rows of one range of the sorted table, about; at most about 100,000 ranges. Characters of a host or path that say where
#: one begins: so the driver holds 100 MB of them at most, and 700,000 hashes of pages at ranges' edges.
RANGE, CUT_CHARS = 1000, 500

_ROW = "bucket int, host string, path string, page_id long, h long, digest string, url string, lines array<string>, inside array<boolean>"
#: What the table is sorted by; h is a hash of the html.
_KEY = ["host", "path", "page_id", "h"]


def _edges(rows: pd.DataFrame) -> pd.DataFrame:
    """The first and last distinct pages of one range: its outermost runs of equal pages, SIDE + 1 at each end; host_key and
    key stand for host and for the whole key."""
    rows = rows.assign(none=rows["page_id"].notna()).sort_values(["host", "path", "none", "page_id", "h"], kind="stable")
    new = (rows["host"] != rows["host"].shift()) | (rows["digest"] != rows["digest"].shift())
    runs = rows[new].assign(at=range(int(new.sum())))
    return runs[(runs["at"] <= SIDE) | (runs["at"] >= len(runs) - SIDE - 1)][["bucket", "at", "host_key", "key", "digest"]]


def _halo(edges: list[tuple]) -> list[tuple]:
    """(range, key, digest) of the rows that ranges take over from those around them.

    edges: (range, place, host_key, key, digest) of _edges. A range takes as many distinct pages of the host at its edge as
    there are within SIDE runs, over as many ranges as these lie in; a run may fill many ranges.
    """
    by_range: dict[int, list[tuple]] = {}
    for e in sorted(edges, key=lambda e: e[:2]):
        by_range.setdefault(e[0], []).append(e)
    out = []
    for step in (1, -1):
        near: list[tuple] = []  # the last distinct pages of the host that the ranges so far end with
        for b in sorted(by_range, reverse=step < 0):
            runs = by_range[b][::step]
            of_host = [e for e in reversed(near) if e[2] == runs[0][2]]
            same = of_host[:1] and of_host[0][4] == runs[0][4]
            out += [(b, *e[3:]) for e in of_host[bool(same) :][:SIDE]]
            for e in runs:
                if near and near[-1][2] != e[2]:
                    near.clear()
                if not near or near[-1][4] != e[4]:
                    near.append(e)
            del near[: -SIDE - 1]
    return out


def page_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null html is empty. Among the pages of a host, sorted by path, page_id and a hash of the html, equal pages in a row are
    one; each is compared with the nearest distinct pages before and after it. Ranges of the sorted table hold the distinct
    pages beyond their edges as well, so results don't depend on where these lie; rows that repeat a page are dealt over as
    many ranges as others. Repeated pages are each a row with the same text. Other columns are ignored; an empty table
    gives an empty one.
    """
    spark = pages.sparkSession
    url = F.col("url")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("html").alias("h"), F.monotonically_increasing_id().alias("place"), "html")
    n = pages.count()
    cuts: list[tuple] = []
    if n > RANGE:
        every = max(1, RANGE // 20, n // 100_000)
        some = keyed.filter(F.pmod(F.xxhash64("page_id", "url", "place"), F.lit(every)) == 0)
        some = some.select(F.substring("host", 1, CUT_CHARS), F.substring("path", 1, CUT_CHARS), "page_id", "h", "place").collect()
        step = max(1, RANGE // every)
        cuts = sorted(set(sorted(_key(*x) for x in some)[step::step]))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hosts, paths, hashes, places, page = (batch.column(c).to_pylist() for c in ("page_id", "host", "path", "h", "place", "html"))
        found = [lines(x or "") for x in page]
        digests = [hashlib.md5(repr(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found]
        buckets = [bisect.bisect_right(cuts, _key(*k)) for k in zip(hosts, paths, ids, hashes, places, strict=True)]
        columns = [pa.array(buckets, pa.int32()), *(batch.column(c) for c in _KEY), pa.array(digests, pa.string()), batch.column("url")]
        columns += [pa.array([[y for y, _ in x] for x in found], pa.list_(pa.string())), pa.array([[y for _, y in x] for x in found], pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", *_KEY, "digest", "url", "lines", "inside"])

    rows = by_batch(keyed, parse, _ROW).withColumn("own", F.lit(True))
    if cuts:
        # pages are parsed twice instead of writing their lines, which takes as much disk as the shuffle
        key = F.xxhash64(*_KEY)
        told = by_batch(keyed, parse, _ROW).select("bucket", *_KEY, "digest", F.xxhash64("host").alias("host_key"), key.alias("key"))
        edges = told.groupBy("bucket").applyInPandas(_edges, "bucket int, at int, host_key long, key long, digest string").collect()
        halo = F.broadcast(spark.createDataFrame(_halo([tuple(e) for e in edges]), "to int, key long, digest string"))
        near = by_batch(keyed.withColumn("key", key).join(halo, "key", "left_semi"), parse, _ROW).drop("bucket")
        taken = near.withColumn("key", key).join(halo, ["key", "digest"]).select(F.col("to").alias("bucket"), *near.columns)
        rows = rows.union(taken.dropDuplicates(["bucket", *_KEY]).withColumn("own", F.lit(False)).select(rows.columns))
    dealt = rows.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", *_KEY)
    return dealt.select("bucket", "host", "digest", "page_id", "url", "own", "lines", "inside").mapInArrow(_compared, "page_id long, url string, text string, n_chars long")


def _key(host: str, path: str, page_id: int | None, h: int, place: int) -> tuple:
    """What tells a row's range; a null page_id comes first, and rows that are equal but for their place go to any."""
    return host, path, page_id is not None, page_id or 0, h, place


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of rows sorted by range, host and path: a window over runs of equal pages of one host."""
    runs: list[tuple[list, list[tuple]]] = []  # lines, (page_id, url) of rows to be told
    at = 0  # the first run not yet told
    now: tuple | None = None
    digest = None
    rows: list[tuple] = []

    def tell() -> None:
        """Tells of the run at `at`; runs too far behind are let go."""
        nonlocal at
        found, own = runs[at]
        if own:
            near = [runs[j][0] for j in (at - 1, at + 1) if 0 <= j < len(runs)]
            far = [runs[j][0] for k in range(2, SIDE + 1) for j in (at - k, at + k) if 0 <= j < len(runs)]
            text = main_text(found, near, far)
            rows.extend((i, u, text, len(text)) for i, u in own)
        at += 1
        while at > SIDE:
            runs.pop(0)
            at -= 1

    def batch(part: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts, sizes = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    def full() -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for r in rows:
            part.append(r)
            size += r[3]
            if size > 8_000_000:
                yield batch(part)
                part, size = [], 0
        rows[:] = part

    for b in batches:
        for range_, host, page, id_, url, own, line, inside in zip(*b.columns, strict=True):
            if (range_.as_py(), host.as_py()) != now:
                while at < len(runs):
                    tell()
                runs.clear()
                at, now, digest = 0, (range_.as_py(), host.as_py()), None
            if page.as_py() != digest:
                digest = page.as_py()
                runs.append((list(zip(line.as_py(), inside.as_py(), strict=True)), []))
                if len(runs) - at > SIDE + 1:
                    tell()
            if own.as_py():
                runs[-1][1].append((id_.as_py(), url.as_py()))
        if sum(r[3] for r in rows) > 8_000_000:
            yield from full()
    while at < len(runs):
        tell()
    yield from full()
    if rows:
        yield batch(rows)
