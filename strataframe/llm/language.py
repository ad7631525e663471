"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters two, three and four bytes wide run over windows of fixed length; each filter's largest response
in a window feeds a softmax over languages. A text's languages are scored by the mean of its windows' log-probabilities,
weighted by their bytes; every byte of every text is in a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import portions, release_memory

#: Width and number of the filters.
FILTERS = ((2, 8), (3, 12), (4, 12))
WINDOW = 256


@dataclass
class ByteNet:
    labels: list[str]
    embedding: np.ndarray  # 256 x e
    kernels: list[np.ndarray]  # width * e x filters, by width
    bias: np.ndarray
    weights: np.ndarray  # filters x labels
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the first two and the last two bytes of a place, for every pair of bytes: all filters as four bytes wide."""
        e = self.embedding.shape[1]
        halves = []
        for half in range(2):
            parts = []
            for (width, n), k in zip(FILTERS, self.kernels, strict=True):
                full = np.zeros((4 * e, n), np.float32)
                full[: width * e] = k
                parts.append(full[2 * half * e : 2 * (half + 1) * e])
            w = np.concatenate(parts, 1)
            halves.append(((self.embedding @ w[:e])[:, None, :] + (self.embedding @ w[e:])[None, :, :]).reshape(65536, -1).astype(np.float32))
        return halves[0], halves[1]


def windows(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All windows of a text, each with the three bytes after it; the last is filled up with zero bytes."""
    n = max(1, -(-len(data) // window))
    flat = np.zeros(n * window + 3, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, window + 3)[::window]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def draw(data: bytes, per_text: int, seed: int) -> np.ndarray:
    """``per_text`` different windows from anywhere in a text (all, if it has fewer)."""
    w = windows(data)
    return w[np.random.default_rng(seed).choice(len(w), min(per_text, len(w)), replace=False)]


def train(texts: list[str], labels: list[str], per_text: int = 3, **options) -> ByteNet:
    """:func:`train_windows` on ``per_text`` windows of each text."""
    drawn = [draw(t.encode("utf-8", "surrogatepass"), per_text, i) for i, t in enumerate(texts)]
    return train_windows(np.concatenate([np.zeros((0, WINDOW + 3), np.uint8), *drawn]), [x for x, d in zip(labels, drawn, strict=True) for _ in d], **options)


def train_windows(x: np.ndarray, labels: list[str], seed: int = 1, epochs: int = 12, rate: float = 0.02, embed: int = 8) -> ByteNet:
    """Fit on labelled windows. With one label, or no window, the net knows that alone."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet(names, rng.normal(0, 0.5, (256, embed)).astype(np.float32), [rng.normal(0, (width * embed) ** -0.5, (width * embed, n)).astype(np.float32) for width, n in FILTERS], np.zeros(sum(n for _, n in FILTERS), np.float32), rng.normal(0, 0.2, (sum(n for _, n in FILTERS), max(len(names), 1))).astype(np.float32), np.zeros(max(len(names), 1), np.float32))
    if len(names) < 2:
        return net
    y = np.searchsorted(names, labels)
    params = [net.embedding, *net.kernels, net.bias, net.weights, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows, target = x[order[at : at + 64]], y[order[at : at + 64]]
            b = len(rows)
            e = net.embedding[rows]  # b x (window + 3) x embed
            best, where = [], []
            for (width, _), k in zip(FILTERS, net.kernels, strict=True):
                cols = np.lib.stride_tricks.sliding_window_view(e, (width, embed), (1, 2))[:, :WINDOW, 0].reshape(b * WINDOW, width * embed)
                r = (cols @ k).reshape(b, WINDOW, -1)
                where.append(r.argmax(1))
                best.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
            pooled = np.concatenate(best, 1) + net.bias
            hidden = np.maximum(pooled, 0)
            p = _softmax(hidden @ net.weights + net.offset)
            p[np.arange(b), target] -= 1
            p /= b
            d_hidden = (p @ net.weights.T) * (pooled > 0)
            d_embed, d_kernels, f = np.zeros_like(net.embedding), [], 0
            for (width, n), k, w in zip(FILTERS, net.kernels, where, strict=True):
                g = d_hidden[:, f : f + n]
                f += n
                spots = w[:, :, None] + np.arange(width)  # b x n x width
                patch = rows[np.arange(b)[:, None, None], spots]  # bytes under each winner
                d_kernels.append(np.einsum("bn,bnj->jn", g, net.embedding[patch].reshape(b, n, -1)))
                np.add.at(d_embed, patch.ravel(), (g[:, :, None] * k.T[None]).reshape(-1, embed))
            for i, (q, g) in enumerate(zip(params, [d_embed, *d_kernels, d_hidden.sum(0), hidden.T @ p, p.sum(0)], strict=True)):
                if not i:
                    step += 1
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores batches of texts with the net's pair tables."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.first, self.second = net.tables()

    def _logits(self, w: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows."""
        pair = (w[:, :-1].astype(np.int32) << 8) | w[:, 1:]
        r = self.first.take(pair[:, :WINDOW], 0)
        r += self.second.take(pair[:, 2 : WINDOW + 2], 0)
        z = np.maximum(r.max(1) + self.net.bias, 0) @ self.net.weights + self.net.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        counts = np.array([max(1, -(-len(b) // WINDOW)) for b in raw])
        every = np.concatenate([windows(b) for b in raw]) if raw else np.zeros((0, WINDOW + 3), np.uint8)
        logs = np.concatenate([self._logits(every[i : i + 64]) for i in range(0, len(every), 64)]) if len(every) else np.zeros((0, len(self.net.labels)))
        first = np.cumsum(counts) - counts
        weight = np.full(len(every), float(WINDOW))
        weight[first + counts - 1] = [max(len(b) - (c - 1) * WINDOW, 1) for b, c in zip(raw, counts.tolist(), strict=True)]
        total = np.add.reduceat(logs * weight[:, None], first, axis=0) if len(raw) else logs
        evidence = np.add.reduceat(weight, first) if len(raw) else weight
        # log-probabilities of neighbouring windows are not independent: the mean, over 4 windows at most
        p = _softmax(total / evidence[:, None] * np.clip(evidence[:, None] / WINDOW, 1, 4)) if len(raw) else logs
        out = []
        for t, row in zip(texts, p, strict=True):
            if not self.net.labels or not t or not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
            else:
                i = int(row.argmax())
                out.append((self.net.labels[i], float(min(1.0, row[i]))))
        return out


def sample(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 1000, per_text: int = 3) -> DataFrame:
    """``(h, label, at, window)``: windows of at most ``per_label`` rows of each label, ``per_text`` of each, from anywhere in their texts.

    Rows are chosen by a hash of key and text, smallest first; equal rows count once, rows without label or text do not
    count. Tasks draw the windows, so the result has at most ``per_label * per_text`` rows of ``WINDOW + 3`` bytes a
    label, however long texts are and whatever their keys.
    """
    rows = df.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    share = F.shiftrightunsigned("h", 11).cast("double") * 2.0**-53
    sizes = rows.select("label", "h").distinct().groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("n"))  # equal rows once
    near = rows.join(F.broadcast(sizes), F.col("label") == F.col("l")).where(share * F.col("n") < 1.5 * per_label).select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            drawn = [draw(t, per_text, x % 2**32) for x, t in zip(h, batch.column(2).cast(pa.binary()).to_pylist(), strict=True)]
            out = [(x, y, i, w.tobytes()) for x, y, d in zip(h, labels, drawn, strict=True) for i, w in enumerate(d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["h", "label", "at", "window"])

    found = near.mapInArrow(run, "h long, label string, at int, window binary").dropDuplicates(["label", "h", "at"])
    order = Window.partitionBy("label").orderBy(F.shiftrightunsigned("h", 1), "h")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= per_label).drop("rank")


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 1000, per_text: int = 3) -> ByteNet:
    """Train on :func:`sample`; the driver holds that sample, and a row for each label is broadcast.

    A table without labelled texts gives a net that knows no label. Columns of other names play no part.
    """
    rows = sorted((r.h, r.label, r.at, bytes(r.window)) for r in sample(df, text, label, key, per_label, per_text).collect())
    return train_windows(np.frombuffer(b"".join(w for *_, w in rows), np.uint8).reshape(-1, WINDOW + 3), [x for _, x, _, _ in rows])


def identify(df: DataFrame, net: ByteNet, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with ``label`` (``und`` for a null text or one without letters) and ``score``, the label's probability.

    Columns of these names are replaced; others, of whatever names, are kept. Every byte of a text counts, however long it
    is. Of equally likely labels the first in order is taken. A net that knows no label says ``und``. Repeated rows are
    scored alike; an empty table stays empty.
    """
    kept = df.drop(label, score)
    place = kept.columns.index(next(c for c in kept.columns if c.lower() == text.lower()))
    names = [f"c{i}" for i in range(len(kept.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for at, rows in portions(batch.column(place)):
                part = batch.slice(at, rows)
                got = scorer.score(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g for g, _ in got]), pa.array([p for _, p in got])], names=[*names, "label", "p"])
        del scorer
        release_memory()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)], StructField("label", StringType()), StructField("p", DoubleType())])
    return kept.toDF(*names).mapInArrow(run, schema).toDF(*kept.columns, label, score)
