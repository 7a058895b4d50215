"""Secret scanning by one deterministic automaton over bytes.

The rules' regular expressions are parsed into one nondeterministic automaton, made deterministic by subset
construction and minimised by partition refinement, over classes of bytes that no rule tells apart. The result is a
transition array; one pass of it over a text's bytes tells for every rule where matches end. Texts in which nothing ends
(nearly all) are done with that. In the others, an automaton of the reversed rule marks where matches start, and the
rule's own automaton, started there, finds the longest end; matches of a rule are leftmost and don't overlap.

Each rule may have a condition on its match that is checked after matching, so a failing match still uses up its text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.tables import by_batch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The match is pattern, of min_length bytes at least.

    head: where given, the match is head followed by a value of min_value bytes at least (head is matched longest).
    tail: where given, a match goes on over the longest tail behind it, if there is one.
    """

    kind: str
    pattern: str
    min_length: int = 1
    head: str = ""
    min_value: int = 0
    tail: str = ""


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\x20*[:=]\x20*[\"']?"

#: The base kinds, in the order in which they are listed among spans that start together, and the added ones after them.
BASE_RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", head=_KEY, min_value=6),
    Rule("access", "AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", "[0-9a-f]{24,}", min_length=24),
)
# A PEM key: old forms' headers, then the body to the END marker; without that marker all base64 runs of 16 bytes or more
# and one shorter run after them. Between runs are blanks or escaped line ends.
_GAP = "([ \t\r\n]|\\[nrt])"
_HEADS = f"({_GAP}*(Proc-Type|DEK-Info): *[A-Za-z0-9,-]+)*"
_TO_END = f"([A-Za-z0-9+/=\"',>]|{_GAP})*-----END [A-Z ]*PRIVATE KEY-----"
_RUNS = f"({_GAP}*[A-Za-z0-9+/=]{{16,}})+({_GAP}+[A-Za-z0-9+/=]+)?"
ADDED_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=f"{_HEADS}({_TO_END}|{_RUNS})"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", min_length=20),
)


class _Nfa:
    """Thompson's construction for: literals, classes, groups, |, ?, *, +, {n}, {n,}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds what tree matches behind state start; the state reached."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.on[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            after = self.add(part, start)
            end = self.state()
            self.empty[start].append(end)
            self.empty[after].append(end)
            start = end
        return start


def parse(pattern: str) -> tuple:
    """The tree of a pattern; every byte of it stands for itself but for ( ) [ ] | ? * + { } ."""
    at = 0

    def alternatives() -> tuple:
        nonlocal at
        found = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence() -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            at += 1
            if c == "(":
                part = alternatives()
                at += 1
            elif c == "[":
                end = pattern.index("]", at + 1)
                body, chosen, i = pattern[at:end], set(), 0
                while i < len(body):
                    if i + 2 < len(body) and body[i + 1] == "-":
                        chosen.update(range(ord(body[i]), ord(body[i + 2]) + 1))
                        i += 3
                    else:
                        chosen.add(ord(body[i]))
                        i += 1
                part, at = ("set", frozenset(chosen)), end + 1
            else:
                part = ("set", frozenset([ord(c)]))
            if at < len(pattern) and pattern[at] in "?*+{":
                q = pattern[at]
                at += 1
                if q == "{":
                    end = pattern.index("}", at)
                    low, comma, high = pattern[at:end].partition(",")
                    at = end + 1
                    part = ("repeat", part, int(low), (int(high) if high else None) if comma else int(low))
                else:
                    part = ("repeat", part, int(q == "+"), 1 if q == "?" else None)
            parts.append(part)
        return ("cat", parts)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unmatched ) in {pattern!r}")
    return tree


def reverse(tree: tuple) -> tuple:
    if tree[0] == "cat":
        return ("cat", [reverse(p) for p in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [reverse(p) for p in tree[1]])
    if tree[0] == "repeat":
        return ("repeat", reverse(tree[1]), *tree[2:])
    return tree


class Automaton:
    """A minimal deterministic automaton for several trees.

    anywhere: it tells where a match ends that may start at any earlier byte; else matches start at the first byte.
    next[state + class] is the following state; states are multiples of the number of classes. States from `hot` on
    accept: accepts[state] is the set of accepted trees' numbers. State `dead` never accepts again (-1: there is none).
    """

    def __init__(self, trees: list[tuple], anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for i, tree in enumerate(trees):
            first = nfa.state()
            nfa.empty[root].append(first)
            ends[nfa.add(tree, first)] = i
        # bytes that the same sets hold are one class
        sets = list({x[0] for x in nfa.on if x})
        signature: dict[tuple[bool, ...], int] = {}
        self.classes = bytes(signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256))
        width = len(signature)
        byte_of = [self.classes.index(k) for k in range(width)]

        def closed(states: set[int]) -> frozenset[int]:
            stack, out = list(states), set(states)
            while stack:
                for x in nfa.empty[stack.pop()]:
                    if x not in out:
                        out.add(x)
                        stack.append(x)
            return frozenset(out)

        base = closed({root})
        numbers, todo, table = {base: 0}, [base], []
        while todo:
            now = todo.pop(0)
            row = []
            for k in range(width):
                after = {nfa.on[x][1] for x in now if nfa.on[x] and byte_of[k] in nfa.on[x][0]}
                got = closed(after | ({root} if anywhere else set()))
                if got not in numbers:
                    numbers[got] = len(numbers)
                    todo.append(got)
                row.append(numbers[got])
            table.append(row)
        accepts = [frozenset(ends[x] for x in s if x in ends) for s in numbers]
        # partition refinement
        block = list(map({a: i for i, a in enumerate(dict.fromkeys(accepts))}.__getitem__, accepts))
        while True:
            keys = [(block[s], *(block[t] for t in table[s])) for s in range(len(table))]
            index = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            refined = [index[k] for k in keys]
            if len(index) == len(set(block)):
                break
            block = refined
        members = {}
        for s, b in enumerate(refined):
            members.setdefault(b, s)
        order = sorted(members, key=lambda b: (bool(accepts[members[b]]), members[b]))
        place = {b: i * width for i, b in enumerate(order)}
        self.width, self.start = width, place[refined[0]]
        self.next = [place[refined[t]] for b in order for t in table[members[b]]]
        self.accepts = {place[b]: accepts[members[b]] for b in order if accepts[members[b]]}
        self.hot = min(self.accepts, default=len(self.next))
        self.dead = next((s for s in range(0, self.hot, width) if all(t == s for t in self.next[s : s + width])), -1)

    def ends(self, data: bytes) -> dict[int, tuple[int, int]]:
        """For each tree that matches somewhere: the first and the last byte position at which a match ends."""
        state, table, hot = self.start, self.next, self.hot
        found: dict[int, tuple[int, int]] = {}
        for i, c in enumerate(data.translate(self.classes), 1):
            state = table[state + c]
            if state >= hot:
                for k in self.accepts[state]:
                    found[k] = (found[k][0] if k in found else i, i)
        return found

    def marks(self, data: bytes) -> list[int]:
        """Positions at which a match ends, ascending."""
        state, table, hot, out = self.start, self.next, self.hot, []
        for i, c in enumerate(data.translate(self.classes), 1):
            state = table[state + c]
            if state >= hot:
                out.append(i)
        return out

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match that starts at the given byte, or -1."""
        state, table, hot, dead, classes, end = self.start, self.next, self.hot, self.dead, self.classes, -1
        if state >= hot:
            end = start
        for i in range(start, len(data)):
            state = table[state + classes[data[i]]]
            if state >= hot:
                end = i + 1
            elif state == dead:
                break
        return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.all = Automaton(trees, anywhere=True)
        self.forward = [Automaton([t], anywhere=False) for t in trees]
        self.backward = [Automaton([reverse(t)], anywhere=True) for t in trees]
        self.heads = [Automaton([parse(r.head)], anywhere=False) if r.head else None for r in rules]
        self.tails = [Automaton([parse(r.tail)], anywhere=False) if r.tail else None for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule's number, end) of every accepted match, in order."""
        out = []
        for k, (_, last) in self.all.ends(data).items():
            rule, done = self.rules[k], 0
            part = data[:last]
            for start in sorted(last - p for p in self.backward[k].marks(part[::-1])):
                if start < done:
                    continue
                end = self.forward[k].longest(data, start)
                if rule.tail:
                    end = max(end, self.tails[k].longest(data, end))
                done = end
                value = end - self.heads[k].longest(data, start) if rule.head else end - start
                if end - start >= rule.min_length and value >= rule.min_value:
                    out.append((start, k, end))
        return sorted(out)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """byte_spans() in code points."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if not found or len(data) == len(text):
            return found
        chars, at, place = {}, 0, 0
        for p in sorted({x for s, _, e in found for x in (s, e)}):
            at += len(data[place:p].decode("utf-8", "surrogatepass"))
            place = p
            chars[p] = at
        return [(chars[s], k, chars[e]) for s, k, e in found]


@lru_cache(8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """One row per document: doc_id, n_<kind> for the first `base` rules, base_sha256, and spans.

    spans: kind:start:end of every match, ordered by start, then by the rules' order, joined by commas; code points, end
    exclusive. base_sha256: lowercase hex SHA-256 of the same string of the first `base` rules alone. A null or empty text
    has no spans. Repeated rows are scanned each.
    """
    kinds = [r.kind for r in rules]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds[:base]) + ", base_sha256 string, spans string"

    compiled = scanner(rules)  # once, on the driver: its arrays depend on the rules only and travel with the function

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = compiled.spans
        rows = []
        for s in batch.column("text"):
            found = find(s.as_py() or "")
            told = [(k, f"{kinds[k]}:{start}:{end}") for start, k, end in found]
            counts = [sum(k == j for _, k, _ in found) for j in range(base)]
            rows.append((*counts, hashlib.sha256(",".join(x for k, x in told if k < base).encode()).hexdigest(), ",".join(x for _, x in told)))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * base + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, schema)


def redact(text: str, compiled: Scanner) -> str:
    """text with each stretch of overlapping matches replaced by [kind] of the first."""
    out, done = [], 0
    for start, k, end in compiled.spans(text):
        if start >= done:
            out += [text[done:start], f"[{compiled.rules[k].kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """docs with secrets replaced in text, and n_chars made to fit where text changed; a null text stays null."""
    compiled = scanner(rules)

    names = docs.columns
    place = names.index("text")
    types = docs.schema.fields
    chars = names.index("n_chars") if "n_chars" in names else -1

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(place).to_pylist()
        new = [t if t is None else redact(t, compiled) for t in old]
        columns = list(batch.columns)
        columns[place] = pa.array(new, batch.column(place).type)
        if chars >= 0:
            sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(chars).to_pylist(), strict=True)]
            columns[chars] = pa.array(sizes, batch.column(chars).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return by_batch(docs, clean, StructType(types))
