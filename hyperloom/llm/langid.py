"""Language identification with a small convolutional network over bytes, trained in numpy.

Bytes have learned vectors; filters of several widths slide over them, each filter's largest answer in a window of fixed length goes into
a softmax.  A text's languages are the mean of its windows' answers, weighted by the bytes in each window, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class NetPlan:
    """Shape and training of the network.  ``docs_per_label`` and ``windows_per_doc`` bound the sample that it learns from, whatever the corpus."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    vector: int = 8
    docs_per_label: int = 500
    windows_per_doc: int = 6
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def _fold(b: np.ndarray) -> np.ndarray:
    """Capitals as small letters, all white space and control characters as one."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:33] = 0
    return table[b]


def cut_windows(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled up with zeros, and the bytes in each."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    weights = np.full(n, size, np.float64)
    weights[-1] = len(text) - (n - 1) * size
    return _fold(out).reshape(n, size), weights


class ByteNet:
    def __init__(self, labels: list[str], plan: NetPlan):
        r = np.random.default_rng(plan.seed)
        self.labels, self.plan = labels, plan
        self.p = {"vectors": r.normal(0, 0.5, (256, plan.vector)).astype(np.float32)}
        for w in plan.widths:
            self.p[f"filter{w}"] = r.normal(0, 1 / np.sqrt(w * plan.vector), (w, plan.vector, plan.filters)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(plan.filters, np.float32)
        n = plan.filters * len(plan.widths)
        self.p["out"] = r.normal(0, 1 / np.sqrt(n), (n, len(labels))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(labels), np.float32)

    def _pooled(self, x: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter in each window, and where it was."""
        best, where = [], []
        for w, table in zip(self.plan.widths, tables or self.tables()):
            n = x.shape[1] - w + 1
            a = table[0][x[:, :n]]
            for o in range(1, w):
                a += table[o][x[:, o : o + n]]
            if tables is None:
                where.append(a.argmax(1))
            best.append(a.max(1))
        return np.concatenate(best, 1) + np.concatenate([self.p[f"bias{w}"] for w in self.plan.widths]), where

    def tables(self) -> list[list[np.ndarray]]:
        """What each byte adds to each filter at each offset; a convolution is then a sum of table rows."""
        return [[self.p["vectors"] @ self.p[f"filter{w}"][o] for o in range(w)] for w in self.plan.widths]

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["out"] + self.p["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        return self._softmax(np.maximum(self._pooled(x, tables)[0], 0))

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteNet:
        """Adam on the cross entropy.  A filter's gradient goes to the bytes under its largest answer alone."""
        plan, r = self.plan, np.random.default_rng(self.plan.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(plan.epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), plan.batch):
                i = order[at : at + plan.batch]
                xb, g = x[i], {}
                raw, where = self._pooled(xb)
                h = np.maximum(raw, 0)
                d = self._softmax(h)
                d[np.arange(len(i)), y[i]] -= 1
                d /= len(i)
                g["out"], g["out_bias"] = h.T @ d, d.sum(0)
                dh = (d @ self.p["out"].T) * (raw > 0)
                g["vectors"] = np.zeros_like(self.p["vectors"])
                for k, w in enumerate(plan.widths):
                    part = dh[:, k * plan.filters : (k + 1) * plan.filters]
                    g[f"bias{w}"] = part.sum(0)
                    gf = np.zeros_like(self.p[f"filter{w}"])
                    for o in range(w):
                        b = np.take_along_axis(xb, where[k] + o, 1)  # the byte under offset o of each filter's best place
                        gf[o] = np.einsum("nf,nfv->vf", part, self.p["vectors"][b])
                        np.add.at(g["vectors"], b, part[:, :, None] * self.p[f"filter{w}"][o].T[None])
                    g[f"filter{w}"] = gf
                step += 1
                rate = plan.rate * (1 - 0.9 * epoch / max(1, plan.epochs))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] = self.p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text, over all its windows."""
        tables = self.tables()
        out = np.zeros((len(texts), len(self.labels)))
        batch, owner, weight, held = [], [], [], 0

        def flush():
            nonlocal held
            if batch:
                p = self.probabilities(np.concatenate(batch), tables)
                np.add.at(out, np.concatenate(owner), p * np.concatenate(weight)[:, None])
                batch.clear(), owner.clear(), weight.clear()
                held = 0

        for k, t in enumerate(texts):
            for at in range(0, max(1, len(t)), 128 * self.plan.window):  # a very long text goes through in parts
                x, w = cut_windows(t[at : at + 128 * self.plan.window], self.plan.window)
                batch.append(x)
                weight.append(np.maximum(w, 1e-9))
                owner.append(np.full(len(x), k))
                held += len(x)
                if held >= 128:
                    flush()
        flush()
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def train(docs: DataFrame, usable: Column, label: str = "lang", text: str = "text", id_column: str = "doc_id", plan: NetPlan = NetPlan()) -> ByteNet | None:
    """A network learned from rows where ``usable`` holds and text and label are there; None if there is no such row.

    A hash of the id draws about ``docs_per_label`` documents of each label; of each one ``windows_per_doc`` evenly spaced windows come to the
    driver.  Repeated rows may be drawn more than once.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(text).alias("text")).filter(usable & F.col("label").isNotNull())
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    chance = F.lit(0.0)
    for k in labels:
        chance = F.when(F.col("label") == k, F.lit(plan.docs_per_label / counts[k])).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit(plan.seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter((draw < chance) & F.col("text").isNotNull() & (F.length("text") > 0)).select("label", "text")
    size, most = plan.window, plan.windows_per_doc

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, _ = cut_windows(t.encode(), size)
                for i in sorted({int(i) for i in np.linspace(0, len(x) - 1, most)}):
                    label.append(k)
                    out.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(out, pa.binary())], ["label", "window"])

    sample = sorted((r.label, bytes(r.window)) for r in drawn.mapInArrow(windows, "label string, window binary").limit(3 * plan.docs_per_label * most * len(labels)).collect())
    if not sample:
        return None
    x = np.stack([np.frombuffer(w, np.uint8) for _, w in sample])
    y = np.array([labels.index(k) for k, _ in sample])
    return ByteNet(labels, plan).train(x, y)


def identify(docs: DataFrame, net: ByteNet | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score (the label's mean probability, 0 to 1) per row.  A null text, one without a letter, or any text if there was nothing to
    learn from, is ``und`` with score 0.  Rows with equal or null ids are judged each for itself."""
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                some = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
                label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if some:
                    p = net.predict([texts[k].encode() for k in some])
                    for k, q in zip(some, p):
                        label[k], score[k] = net.labels[int(q.argmax())], min(1.0, float(q.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], [id_column, "lang_pred", "score"])

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {key}, lang_pred string, score double")
