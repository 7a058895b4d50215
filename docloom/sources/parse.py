"""Documents from plain text, Markdown, HTML, DOCX, EPUB and PDF: title and sections of blocks."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator, Set
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.parts import cuts
from docloom.providers import Parsers
from docloom.sources.detect import decoded, detect_format, with_hint
from docloom.sources.pdf import pdf_text

BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])
SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("blocks", T.ArrayType(BLOCK))])
DOCUMENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("error", T.StringType())])


def block(kind: str, text: str | None = None, level: int | None = None, language: str | None = None, items: list[str] | None = None) -> dict:
    return {"kind": kind, "level": level, "language": language, "text": text, "items": items}


def document(title: str | None, sections: list[dict], error: str | None = None) -> dict:
    return {"title": title, "sections": sections, "error": error}


def plain(text: str) -> dict:
    """Paragraphs between blank lines; a one-line paragraph that begins with # and a space is a heading."""
    blocks = []
    for part in text.split("\n\n"):
        part = part.strip()
        if part.startswith("# ") and "\n" not in part:
            blocks.append(block("heading", part[2:].strip(), 1))
        elif part:
            blocks.append(block("paragraph", part))
    headings = [b["text"] for b in blocks if b["kind"] == "heading"]
    first = text.strip().split("\n", 1)[0].strip()
    return document(headings[-1] if headings else first or None, [{"heading": None, "level": 0, "blocks": blocks or [block("plain", text.strip())]}])


# How lines of Markdown begin.
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})\s*(\S*)")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])(?:( +)(.*)|$)")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_RAW = re.compile(r" {0,3}<(?:(!--)|(script|pre|style|textarea)\b|[!?]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))", re.I)
_REFERENCE = re.compile(r" {0,3}\[([^\]\\]+)\]:[ \t]*\S+.*$")
_TASK = re.compile(r"\[[ xX]\][ \t]+")

_CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_INLINE = [
    (re.compile(r"<((?:https?|ftp|mailto):[^\s<>]*|[\w.+-]+@[\w.-]+)>", re.I), r"\1"),
    (re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<[!?][^<>]*>", re.S), ""),
    (re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:<[^<>]*>|(?:[^\s()]|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"), r"\1"),
]
_LABELLED = re.compile(r"!?\[([^\[\]]+)\](?:\[([^\[\]]*)\])?")


_RUN = re.compile(r"\*+|_+|~~+")


def _mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def _without_emphasis(text: str) -> str:
    """text without the marks of emphasis and strikethrough: in one pass, each run that can close takes marks off the last
    open run of its kind, and runs between the two stay as they are."""
    gone: list[tuple[int, int]] = []
    open_: list[list] = []  # mark, first and last place of what is left of a run
    of_kind: dict[str, list[int]] = {"*": [], "_": [], "~": []}
    for m in _RUN.finditer(text):
        kind, start, end = m[0][0], m.start(), m.end()
        before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
        left = not after.isspace() and (not _mark(after) or before.isspace() or _mark(before))
        right = not before.isspace() and (not _mark(before) or after.isspace() or _mark(after))
        opens, closes = (left, right) if kind != "_" else (left and (not right or _mark(before)), right and (not left or _mark(after)))
        if kind == "~" and end - start != 2:
            continue
        while closes and start < end and of_kind[kind]:
            at = of_kind[kind][-1]
            for other, *_ in open_[at + 1 :]:
                of_kind[other].pop()
            del open_[at + 1 :]
            first, last = open_[at][1:]
            n = 2 if min(last - first, end - start) > 1 else 1
            gone += [(last - n, last), (start, start + n)]
            start += n
            open_[at][2] = last - n
            if open_[at][1] == open_[at][2]:
                open_.pop()
                of_kind[kind].pop()
        if opens and start < end:
            of_kind[kind].append(len(open_))
            open_.append([kind, start, end])
    parts, at = [], 0
    for start, end in sorted(gone):
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])


def inline(text: str, labels: Set[str] = frozenset()) -> str:
    """The text that inline Markdown shows. labels: names of link definitions."""
    kept: list[str] = []

    def keep(shown: str) -> str:
        kept.append(shown)
        return f"\x02{len(kept) - 1}\x03"

    text = text.replace("\x02", "").replace("\x03", "")
    text = _CODE_SPAN.sub(lambda m: keep(m[2][1:-1] if m[2][:1] == m[2][-1:] == " " and m[2].strip() else m[2]), text)
    text = _ESCAPE.sub(lambda m: keep(m[1]), text)
    for pattern, by in _INLINE:
        text = pattern.sub(by, text)
    if labels:
        text = _LABELLED.sub(lambda m: m[1] if (m[2] or m[1]).strip().lower() in labels else m[0], text)
    text = unescape(_without_emphasis(text))
    while "\x02" in text:
        text = re.sub("\x02(\\d+)\x03", lambda m: kept[int(m[1])], text)
    return text.strip()


def _begins_block(line: str) -> bool:
    """Whether a line ends a paragraph in front of it."""
    item = _ITEM.match(line)
    listed = item and len(item[1]) < 4 and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1")
    return bool(not line.strip() or _FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or listed or _raw_end(line, True))


# Elements that begin a block of HTML wherever a paragraph could end.
_HTML_BLOCKS = frozenset("address article aside base blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu nav ol optgroup option p param section summary table tbody td tfoot th thead title tr track ul script pre style textarea".split())


def _raw_end(line: str, within: bool) -> str | None:
    """What ends a block of HTML that begins with line: a mark, or an empty text for a blank line; None if none begins.
    within: it would end a paragraph, so only elements that make blocks count."""
    m = _RAW.match(line)
    if not m:
        return None
    if m[1] or m[2]:
        return "-->" if m[1] else f"</{m[2].lower()}"
    name = re.match(r" {0,3}</?([A-Za-z0-9]*)", line)[1].lower()
    if not name:
        return ">"
    alone = re.fullmatch(r" {0,3}</?[A-Za-z][^<>]*>\s*", line)
    return "" if name in _HTML_BLOCKS or alone and not within else None


#: Lists and quotes within each other that are read as such.
MOST_DEEP = 40


class _Markdown:
    """Blocks of lines, one after the other; what a list or quote holds is read as Markdown of its own."""

    def __init__(self, lines: list[str], labels: Set[str], depth: int = 0) -> None:
        self.lines, self.labels, self.depth, self.blocks = lines, labels, depth, []
        i = 0
        while i < len(lines):
            i = self.one(i)

    def show(self, text: str) -> str:
        return inline(text, self.labels)

    def one(self, i: int) -> int:
        """Adds the block that begins at line i; the line after it."""
        lines, line = self.lines, self.lines[i]
        if not line.strip():
            return i + 1
        if line.startswith("    "):
            return self.indented(i)
        if m := _FENCE.match(line):
            end, shift = i + 1, len(line) - len(line.lstrip())
            while end < len(lines) and not re.match(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}\s*$", lines[end]):
                end += 1
            code = [re.sub(rf"^ {{0,{shift}}}", "", x) for x in lines[i + 1 : end]]
            self.blocks.append(block("code", "\n".join(code).strip(), language=m[2] or None))
            return end + 1
        if m := _ATX.match(line):
            self.blocks.append(block("heading", self.show((m[2] or "").strip()), len(m[1])))
            return i + 1
        if _RULE.match(line):
            return i + 1
        if _QUOTE.match(line) and self.depth < MOST_DEEP:
            return self.quote(i)
        if (m := _ITEM.match(line)) and len(m[1]) < 4 and self.depth < MOST_DEEP:
            return self.list_(i)
        if (end := _raw_end(line, False)) is not None:
            while i < len(lines) and (lines[i].strip() if end == "" else end not in lines[i].lower()):
                i += 1
            return i + 1
        if "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and _DELIMITER.match(lines[i + 1]):
            end = i
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            self.blocks.append(block("plain", "\n".join(x.strip() for x in lines[i:end])))
            return end
        return self.paragraph(i)

    def indented(self, i: int) -> int:
        code = []
        while i < len(self.lines) and (self.lines[i].startswith("    ") or not self.lines[i].strip()):
            code.append(self.lines[i][4:])
            i += 1
        self.blocks.append(block("code", "\n".join(code).strip("\n").rstrip()))
        return i

    def paragraph(self, i: int) -> int:
        words = [self.lines[i].strip()]
        i += 1
        while i < len(self.lines):
            if m := _UNDERLINE.match(self.lines[i]):
                self.blocks.append(block("heading", self.show(" ".join(words)), 1 if m[1][0] == "=" else 2))
                return i + 1
            if _begins_block(self.lines[i]):
                break
            words.append(self.lines[i].strip())
            i += 1
        if shown := self.show(" ".join(w.removesuffix("\\") if k < len(words) - 1 else w for k, w in enumerate(words))):
            self.blocks.append(block("paragraph", shown))
        return i

    def quote(self, i: int) -> int:
        inner: list[str] = []
        while i < len(self.lines) and (_QUOTE.match(self.lines[i]) or inner and inner[-1].strip() and not _begins_block(self.lines[i])):
            inner.append(_QUOTE.sub("", self.lines[i], count=1))
            i += 1
        told = [b["text"] or " ".join(b["items"] or []) for b in _Markdown(inner, self.labels, self.depth + 1).blocks]
        if shown := " ".join(filter(None, told)):
            self.blocks.append(block("quote", shown))
        return i

    def list_(self, i: int) -> int:
        """One list: items of lists inside it stand behind the item that holds them; other blocks are part of their item."""
        lines, items = self.lines, []
        kind = _ITEM.match(lines[i])[2][-1]
        while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and len(m[1]) < 4 and not _RULE.match(lines[i]):
            depth = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) < 5 and m[4] else 1)
            inner = [lines[i][depth:]] if m[4] else [""]
            i += 1
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    following = next((x for x in lines[i:] if x.strip()), "")
                    if not following.startswith(" " * depth):
                        break
                    inner.append("")
                elif line.startswith(" " * depth):
                    inner.append(line[depth:])
                elif _begins_block(line) or _ITEM.match(line) or not inner[-1].strip():
                    break
                else:
                    inner.append(line.strip())
                i += 1
            inner[0] = _TASK.sub("", inner[0], count=1)
            own, below = [], []
            for b in _Markdown(inner, self.labels, self.depth + 1).blocks:
                if b["kind"] == "list":
                    below += b["items"]
                elif b["text"]:
                    own.append(b["text"])
            items += [" ".join(own), *below] if own or not below else below
            while i < len(lines) and not lines[i].strip() and (nxt := next((x for x in lines[i:] if x.strip()), "")) and (n := _ITEM.match(nxt)) and n[2][-1] == kind and len(n[1]) < 4 and not _RULE.match(nxt):
                i += 1
        if items := [x for x in items if x]:
            self.blocks.append(block("list", items=items))
        return i


def markdown(text: str) -> dict:
    """Headings, paragraphs, lists, quotes, code and tables; headings below the first level begin sections, and the first
    one of the first level is the title. Rules, HTML and link definitions show nothing; without any block, the text is
    plain."""
    lines, labels, fence = [], set(), None
    for line in text.expandtabs(4).splitlines():
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence is not None and m and m[1].startswith(fence) and not m[2]:
            fence = None
        elif fence is None and (d := _REFERENCE.match(line)):
            labels.add(d[1].strip().lower())
            continue
        lines.append(line)
    sections = [{"heading": None, "level": 0, "blocks": []}]
    title = None
    for b in _Markdown(lines, labels).blocks:
        if b["kind"] == "heading":
            title = title or (b["text"] if b["level"] == 1 else None)
            if b["level"] > 1:
                sections.append({"heading": b["text"], "level": b["level"], "blocks": []})
        sections[-1]["blocks"].append(b)
    filled = [s for s in sections if s["blocks"]]
    return document(title, filled) if filled else plain(text)


_TAKEN = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol".split())
_HOLDERS = frozenset("ul ol blockquote pre".split())
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Blocks in page order; an element inside a list, quote or preformatted block is part of that."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.title: str | None = None
        self.first: str | None = None
        self.open: list[str] = []
        self.text: list[str] = []
        self.item: list[str] | None = None
        self.items: list[str] = []
        self.taken: str | None = None
        self.depth = 0

    def _close(self, name: str) -> None:
        if name not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if last == "title":
                self.title = self.title or " ".join("".join(self.text).split()) or None
                self.text = []
            if last == "li" and self.item is not None and len(self.open) == self.depth + 1:
                self.items.append(" ".join("".join(self.item).split()))
                self.item = None
            if self.taken == last and len(self.open) == self.depth:
                self._finish(last)
            if last == name:
                return

    def _finish(self, name: str) -> None:
        raw = "".join(self.text)
        flat = " ".join(raw.split())
        if name in ("ul", "ol"):
            if items := [x for x in self.items if x]:
                self.blocks.append(block("list", items=items))
        elif name == "pre":
            if raw.strip():
                self.blocks.append(block("code", raw.strip("\n")))
        elif flat:
            kind = "heading" if name[0] == "h" else "quote" if name == "blockquote" else "paragraph"
            self.blocks.append(block(kind, flat, int(name[1]) if kind == "heading" else None))
            if name == "h1":
                self.first = self.first or flat
        self.taken, self.text, self.items, self.item = None, [], [], None

    def handle_starttag(self, name: str, attrs) -> None:
        if name in _EMPTY:
            return
        if name in _TAKEN | {"div", "section", "article", "table"} and "p" in self.open and not self.taken_holds():
            self._close("p")
        if name == "li" and "li" in self.open and self.open[-1] == "li":
            self._close("li")
        if name in _TAKEN and self.taken is None:
            self.taken, self.depth, self.text, self.items = name, len(self.open), [], []
        elif name == "li" and self.taken in ("ul", "ol") and len(self.open) == self.depth + 1:
            self.item = []
        if name == "title":
            self.text = []
        self.open.append(name)

    def taken_holds(self) -> bool:
        return self.taken in _HOLDERS

    def handle_endtag(self, name: str) -> None:
        self._close(name)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] in ("script", "style"):
            return
        if self.item is not None:
            self.item.append(data)
        if self.taken or self.open and self.open[-1] == "title":
            self.text.append(data)


def html(text: str) -> dict:
    """Blocks of headings, paragraphs, lists, quotes and preformatted text; without any, the text without tags as plain text."""
    page = _Page()
    page.feed(text)
    page.close()
    if page.open:
        page._close(page.open[0])
    if page.blocks:
        return document(page.title or page.first, [{"heading": None, "level": 0, "blocks": page.blocks}])
    return plain(re.sub(r"<[^>]*(>|$)", "", text).replace(">", ""))


def closed_references(text: Column) -> Column:
    """HTML whose character references without a semicolon stand as they are when it is parsed (HTML itself decodes some)."""
    return F.regexp_replace(text, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(data: bytes) -> dict:
    """Paragraphs of a DOCX file; styles heading n and title n are headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    blocks, title = [], None
    for p in body.iterfind(f"{_WORD}p"):
        parts = []
        for x in p.iter():
            parts.append(x.text or "" if x.tag == f"{_WORD}t" else "\t" if x.tag == f"{_WORD}tab" else "\n" if x.tag == f"{_WORD}br" else "")
        line = "".join(parts).strip()
        style = next((s.get(f"{_WORD}val", "") for s in p.iter(f"{_WORD}pStyle")), "").lower()
        if not line:
            continue
        digits = "".join(c for c in style if c.isdigit())
        if style.startswith(("heading", "title")):
            level = int(digits) if digits and 1 <= int(digits) <= 9 else 1
            blocks.append(block("heading", line, level))
            title = title or (line if level == 1 else None)
        else:
            blocks.append(block("paragraph", line))
    return document(title, [{"heading": None, "level": 0, "blocks": blocks}])


def epub(data: bytes) -> dict:
    """The parts of an EPUB file in reading order, without tags, as plain text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in root.iter() if x.tag.endswith("rootfile"))
        opf = ElementTree.fromstring(z.read(package))
        folder = package.rpartition("/")[0]
        files = {x.get("id"): x.get("href") for x in opf.iter() if x.tag.endswith("}item")}
        order = [files[x.get("idref")] for x in opf.iter() if x.tag.endswith("}itemref") and x.get("idref") in files]
        parts = [re.sub(r"<[^>]*>", "", z.read(f"{folder}/{f}" if folder else f).decode("utf-8", "replace")).strip() for f in order]
        named = next((x.text for x in opf.iter() if x.tag.endswith("}title")), None)
    found = plain("\n\n".join(parts))
    return found if any(b["kind"] == "heading" for s in found["sections"] for b in s["blocks"]) else {**found, "title": named or found["title"]}


_TEXT = {"unknown": plain, "plaintext": plain, "markdown": markdown, "html": html}
_BINARY = {"docx": docx, "epub": epub, "pdf": lambda data: plain(pdf_text(data))}


def parse(kind: str, content: bytes | None) -> dict:
    """A document of bytes of the given format. What can't be parsed gives an error and no sections, never an exception."""
    if not content:
        return document(None, [], "empty input")
    try:
        if kind in _TEXT:
            return _TEXT[kind](content.decode("utf-8", "replace"))
        if kind in _BINARY:
            return _BINARY[kind](content)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, StopIteration, RecursionError, OverflowError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return document(None, [], f"{kind}: {e}")
    return document(None, [], f"unsupported format: {kind}")


def _parsed(one: Callable[[str, bytes | None], dict]):
    """A function of the columns kind and content, a few documents at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    made = to_arrow_type(DOCUMENT)

    @F.arrow_udf(DOCUMENT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kind, content in batches:
            for at, n in cuts(content):
                yield pa.array([one(k, c) for k, c in zip(kind.slice(at, n).to_pylist(), content.slice(at, n).to_pylist(), strict=True)], made)

    return run


#: parse() of each row of the columns kind and content.
parsed = _parsed(parse)


def parsed_by(parsers: Parsers, kind: Column, content: Column) -> Column:
    """parsed(), with the user's parsers in front; what they raise is the row's error."""
    own = parsers.by_format

    def one(k: str, c: bytes | None) -> dict:
        if k not in own or not c:
            return parse(k, c)
        try:
            return own[k](c)
        except Exception as e:  # whatever a user's parser raises
            return document(None, [], f"{k}: {e}")

    return _parsed(one)(kind, content)


def read_documents(df: DataFrame, content: str = "content", hint: str | None = None, parsers: Parsers | None = None) -> DataFrame:
    """df with format and doc (title, sections, error) of its binary column."""
    df = df.withColumn("format", with_hint(detect_format(F.col(content)), hint))
    return df.withColumn("doc", parsed_by(parsers, F.col("format"), F.col(content)) if parsers and parsers.by_format else parsed("format", content))


def full_text(doc: Column, without: tuple[str, ...] = ()) -> Column:
    """Text of all blocks but those of the kinds in without, joined by blank lines, items of a list by line ends."""
    blocks = F.flatten(F.transform(doc["sections"], lambda s: s["blocks"]))
    if without:
        blocks = F.filter(blocks, lambda b: ~b["kind"].isin(*without))
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.array_join(b["items"], "\n"))), "\n\n")


def lines_text(kind: Column, content: Column, doc: Column) -> Column:
    """A document's text with its lines as they stand: the decoded bytes of text and Markdown, else the text of its blocks."""
    return F.when(kind.isin("plaintext", "markdown", "unknown"), decoded(content)).otherwise(full_text(doc))
