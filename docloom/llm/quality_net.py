"""A byte-level convolutional network in numpy that tells good texts from bad ones.

A text's bytes are embedded, filters slide over them, and their rectified responses are max-pooled within chunks of 256
bytes; a chunk begins every 192 bytes, so chunks overlap and cover the whole text. A hidden layer looks at each chunk's
pooled responses; the mean and the maximum of its outputs over all chunks give one probability. Inputs are bytes alone.

Training runs on the driver over a sample whose size is a parameter; scoring is a map over all rows. A text is scored by
itself in double precision, in strips of chunks of fixed size, so its score depends on nothing but its bytes and memory
doesn't grow with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import by_batch, drop, written

STEP, WIDTH, PART = 4, 12, 64  # bytes: between filter positions, under a filter, of a part of a chunk
PARTS, HOP = 4, 3  # parts in a chunk, and between the beginnings of two chunks
EMBED, FILTERS, HIDDEN = 4, 32, 16
STRIP = 340  # chunks that are scored at a time
PLACES = 9  # decimal places of a score
PASS_BYTES = 1_000_000  # of texts that training looks at together


@dataclass(frozen=True)
class Training:
    """texts: labelled rows sampled at most, half of each label. sample_bytes: of whole texts of the sample, together.

    Rows come in hash order and whole, up to the first that passes sample_bytes (one row is always taken).
    """

    texts: int = 2400
    sample_bytes: int = 32_000_000
    rounds: int = 8
    batch: int = 48
    rate: float = 4e-3
    seed: int = 5


class Net:
    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": r.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    @staticmethod
    def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, each text filled up with spaces to whole parts (one at least, with room for a filter) and a blank part
        behind it, so that no filter reaches the next text; and each text's number of parts without the blank one."""
        parts = [(len(t) + WIDTH) // PART + 1 for t in texts]
        joined = b"".join(t.ljust((n + 1) * PART, b" ") for t, n in zip(texts, parts, strict=True)) + b" " * WIDTH
        return np.frombuffer(joined, np.uint8), np.array(parts)

    def windows(self, data: np.ndarray, first: int, last: int) -> np.ndarray:
        """Embedded bytes under each filter position of parts first to last."""
        vec = self.p["embed"][data[first * PART : last * PART + WIDTH]]
        n = (last - first) * PART // STEP
        view = np.lib.stride_tricks.as_strided(vec, (n, WIDTH * EMBED), (STEP * vec.strides[0], vec.strides[1]), writeable=False)
        return np.ascontiguousarray(view)

    def pooled(self, data: np.ndarray, n_parts: int, winners: np.ndarray | None = None) -> np.ndarray:
        """The largest response of each filter in each part; its position goes to winners, where given."""
        out = np.empty((n_parts, FILTERS), self.p["bias"].dtype)
        for a in range(0, n_parts, 1024):
            b = min(n_parts, a + 1024)
            response = (self.windows(data, a, b) @ self.p["filter"]).reshape(b - a, PART // STEP, FILTERS)
            out[a:b] = response.max(1)
            if winners is not None:
                winners[a:b] = response.argmax(1)
        return np.maximum(out + self.p["bias"], 0)

    @staticmethod
    def chunks(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the parts of each chunk (a text's last part is repeated to fill its last chunk), and each text's first chunk."""
        counts = np.maximum(1, -(-np.maximum(parts - PARTS, 0) // HOP) + 1)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        begin = np.concatenate([[0], np.cumsum(parts + 1)[:-1]])
        text = np.repeat(np.arange(len(parts)), counts)
        at = (np.arange(len(text)) - firsts[text]) * HOP
        index = np.minimum(at[:, None] + np.arange(PARTS), parts[text, None] - 1) + begin[text, None]
        return index, firsts

    def hidden(self, feature: np.ndarray) -> np.ndarray:
        return np.tanh(feature @ self.p["hidden"] + self.p["hidden_bias"])

    def forward(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """What training needs of several texts at once."""
        p = self.p
        data, parts = self.laid_out(texts)
        n = int((parts + 1).sum())
        winners = np.empty((n, FILTERS), np.int8)
        pool = self.pooled(data, n, winners)
        index, firsts = self.chunks(parts)
        feature, part = pool[index[:, 0]], np.repeat(index[:, :1], FILTERS, 1)
        for j in range(1, PARTS):
            more = pool[index[:, j]]
            part = np.where(more > feature, index[:, j, None], part)
            feature = np.maximum(feature, more)
        hidden = self.hidden(feature)
        sizes = np.diff(np.append(firsts, len(index)))
        mean = np.add.reduceat(hidden, firsts) / sizes[:, None]
        top = np.maximum.reduceat(hidden, firsts)
        z = np.concatenate([mean, top], 1) @ p["out"] + p["out_bias"]
        return {"data": data, "part": part, "firsts": firsts, "sizes": sizes, "feature": feature, "hidden": hidden, "mean": mean, "top": top, "z": z, "winners": winners}

    def precise(self) -> Net:
        """The same net in double precision, for scoring."""
        out = Net.__new__(Net)
        out.p = {k: v.astype(np.float64) for k, v in self.p.items()}
        return out

    def score(self, text: bytes) -> float:
        """The probability of one text, from its bytes alone: strips of chunks of fixed size, whose sums and maxima are kept."""
        n_parts = (len(text) + WIDTH) // PART + 1
        n_chunks = max(1, -(-max(n_parts - PARTS, 0) // HOP) + 1)
        total, top = np.zeros(HIDDEN), np.full(HIDDEN, -np.inf)
        for a in range(0, n_chunks, STRIP):
            b = min(n_chunks, a + STRIP)
            first, last = a * HOP, min(n_parts, (b - 1) * HOP + PARTS)
            strip = text[first * PART : last * PART + WIDTH].ljust((last - first) * PART + WIDTH, b" ")
            pool = self.pooled(np.frombuffer(strip, np.uint8), last - first)
            at = np.arange(b - a) * HOP
            feature = pool[at]
            for j in range(1, PARTS):
                np.maximum(feature, pool[np.minimum(at + j, last - first - 1)], out=feature)
            hidden = self.hidden(feature)
            total += hidden.sum(0)
            np.maximum(top, hidden.max(0), out=top)
        z = float(np.concatenate([total / n_chunks, top]) @ self.p["out"] + self.p["out_bias"][0])
        return round(1 / (1 + math.exp(-z)) if z > -700 else 0.0, PLACES)

    def gradient(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss over `of` texts (these, if None), their part of the mean. Only the positions that won
        a pool have a part in the filters' gradient."""
        p, f = self.p, self.forward(texts)
        dz = ((1 / (1 + np.exp(-f["z"])) - labels) * weights / (of or len(texts))).astype(np.float32)
        g = {"out": np.concatenate([f["mean"], f["top"]], 1).T @ dz, "out_bias": dz.sum(keepdims=True)}
        text = np.repeat(np.arange(len(texts)), f["sizes"])
        dh = (dz / f["sizes"])[text, None] * p["out"][:HIDDEN]
        best = f["hidden"] == f["top"][text]
        ties = np.add.reduceat(best, f["firsts"])[text]
        dh = (dh + best / ties * dz[text, None] * p["out"][HIDDEN:]) * (1 - f["hidden"] ** 2)
        g["hidden"], g["hidden_bias"] = f["feature"].T @ dh, dh.sum(0)
        df = (dh @ p["hidden"].T) * (f["feature"] > 0)
        chunk, k = np.nonzero(df)
        d = df[chunk, k]
        part = f["part"][chunk, k]
        under = f["data"][(part * PART + f["winners"][part, k].astype(np.int64) * STEP)[:, None] + np.arange(WIDTH)]  # bytes under the winning filter
        g["filter"] = np.zeros_like(p["filter"])
        for j in range(FILTERS):
            own = k == j
            g["filter"][:, j] = d[own] @ p["embed"][under[own]].reshape(-1, WIDTH * EMBED)
        g["bias"] = np.bincount(k, d, FILTERS)
        back = (p["filter"].T[k] * d[:, None]).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(under.ravel(), back[:, j], 256) for j in range(EMBED)], 1)
        return g

    def batch_gradient(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """gradient(), over parts of about PASS_BYTES, so that long texts don't meet in memory."""
        total: dict[str, np.ndarray] = {}
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= PASS_BYTES):
                size += len(texts[b])
                b += 1
            for k, g in self.gradient(texts[a:b], labels[a:b], weights[a:b], len(texts)).items():
                total[k] = total[k] + g if k in total else g
            a = b
        return total

    def train(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, t: Training) -> Net:
        r = np.random.default_rng(t.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = t.rounds * -(-len(texts) // t.batch)
        n = 0
        for _ in range(t.rounds):
            order = r.permutation(len(texts))
            for a in range(0, len(texts), t.batch):
                some = order[a : a + t.batch]
                n += 1
                rate = t.rate * (1 - n / (steps + 1))
                for k, g in self.batch_gradient([texts[i] for i in some], labels[some], weights[some]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame, t: Training) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Whole texts of labelled rows, half of each label, their labels, and weights that restore the labels' shares.

    Rows come in the order of a hash of their id, so the sample is the same however the tables are stored; Training has
    its bounds. Null and other labels than 0 and 1 aren't used, of labels that contradict each other 1 holds, and of
    texts under one id the least.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        half = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.texts // 2)
        picked = half if picked is None else picked.union(half)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = keyed.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = written(found.withColumn("h", F.xxhash64("doc_id")), "quality-sample")
    sizes = sorted(tuple(r) for r in found.select("h", "doc_id", F.octet_length("text").alias("n")).collect())
    total, ids = 0, []
    for _, i, n in sizes:
        if ids and total + n > t.sample_bytes:
            break
        total += n
        ids.append(i)
    taken = found if len(ids) == len(sizes) else found.filter(F.col("doc_id").isin(ids))
    rows = sorted(taken.select("doc_id", "quality", "text").collect(), key=lambda r: r["doc_id"])
    drop(found)
    y = np.array([r["quality"] for r in rows], np.float32)
    total = max(1, sum(counts.values()))
    share = {q: counts.get(q, 0) / total / max(1e-9, (y == q).mean() if len(y) else 1) for q in (0, 1)}
    return [r["text"].encode() for r in rows], y, np.array([share[int(q)] for q in y], np.float32)


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Net:
    """A net for labels(doc_id, quality); without any labelled text it scores everything alike."""
    texts, y, w = sample(docs, labels, t)
    net = Net(t.seed)
    return net.train(texts, y, w, t) if texts else net


def score(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, nine decimal places) of its whole text, predicted (1 if score >= threshold, else 0).

    A score depends on the text alone: equal texts have equal scores, however rows are dealt. A null text is an empty one;
    empty texts get the score of blank space. Repeated rows are scored each; other columns are ignored; an empty table
    gives an empty one.
    """
    exact = net.precise()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([exact.score((x.as_py() or "").encode()) for x in batch.column("text")])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
