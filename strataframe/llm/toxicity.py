"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its words and their first letters; the text's is the
noisy-or of its sentences', so labels of whole texts train a model that says which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import cut, portions

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")
FEATURES = 1 << 18
#: Probability of a sentence without known features, before training; a text has some tens of them.
PRIOR = -9.0


def features(word: str) -> tuple[int, int, int]:
    """Hashed features of a word in lower case: itself, its first four and its first five letters."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in ("w" + word, "4" + word[:4], "5" + word[:5]))


@dataclass
class ToxicNet:
    weights: np.ndarray
    bias: float


class _Words:
    """Words as numbers, with their features; at most ``keep`` are remembered."""

    def __init__(self, keep: int = 500_000):
        self.keep, self.number, self.rows = keep, {}, []

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words as numbers, the sentence of each, and the number of sentences of each text (1 at least)."""
        tokens = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        flat = list(chain.from_iterable(tokens))
        found = list(map(self.number.get, flat))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = flat[i]
                    x = self.number.get(w)
                    if x is None:
                        x = -1 if w in _STOPS else len(self.rows)
                        if x >= 0:
                            self.rows.append(features(w))
                        self.number[w] = x
                    found[i] = x
        at = np.array(found, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stop = at < 0
        new = np.r_[np.zeros(1, bool), stop][: len(at)]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        inner = np.cumsum(new)
        base = np.r_[0, inner][np.minimum(starts, len(at))] if len(at) else np.zeros(len(tokens), np.int64)
        first = np.where(lengths > 0, inner[np.minimum(starts, max(len(at) - 1, 0))] if len(at) else 0, base)
        last = np.where(lengths > 0, inner[np.maximum(ends - 1, 0)] if len(at) else 0, first)
        counts = last - first + 1
        offset = np.cumsum(counts) - counts
        sentence = inner + np.repeat(offset - first, lengths)
        keep = ~stop
        return at[keep], sentence[keep], counts

    def full(self) -> bool:
        return len(self.number) > self.keep


def _noisy_or(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    return -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first))


def train(texts: list[str], labels: list[int], epochs: int = 120, rate: float = 0.7, decay: float = 2e-5, min_texts: int = 4) -> ToxicNet:
    """Fit by adaptive full-batch gradient steps on the noisy-or likelihood; features of under ``min_texts`` texts have no weight."""
    weights, bias = np.zeros(FEATURES), PRIOR
    if not texts or len(set(labels)) < 2:
        return ToxicNet(weights, bias)
    words = _Words(1 << 60)
    y, n, sizes, lines, found = np.array(labels, float), 0, [], [], []
    texts_with = np.zeros(FEATURES, np.int32)
    for lo in range(0, len(texts), 200):
        at, sentence, counts = words.bags(texts[lo : lo + 200])
        table = np.array(words.rows, np.int32).reshape(-1, 3)
        pair = np.unique(sentence * np.int64(max(len(table), 1)) + at)  # words of a sentence count once
        sentence, cols = pair // max(len(table), 1), table[pair % max(len(table), 1)]
        owner = np.repeat(np.arange(len(counts)), counts)
        of_text = np.unique((owner[sentence][:, None] * np.int64(FEATURES) + cols).ravel())
        texts_with += np.bincount(of_text % FEATURES, minlength=FEATURES).astype(np.int32)
        lines.append(np.repeat((sentence + n).astype(np.int32), 3))
        found.append(cols.ravel())
        sizes.append(counts)
        n += int(counts.sum())
    del words
    common = texts_with >= min_texts
    place = np.where(common, np.cumsum(common), 0).astype(np.int32)  # features in use from 1 on; 0 stands for the others
    for i, f in enumerate(found):
        kept = place[f]
        lines[i], found[i] = lines[i][kept > 0], kept[kept > 0]
    counts = np.concatenate(sizes)
    owner = np.repeat(np.arange(len(counts)), counts)
    w = np.zeros(int(common.sum()) + 1)
    g_w, g_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):
        z = np.full(n, bias)
        for line, feature in zip(lines, found, strict=True):
            if len(line):
                first = int(line[0])
                part = np.bincount(line - first, weights=w[feature])
                z[first : first + len(part)] += part
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.clip(_noisy_or(p, counts), 1e-9, 1 - 1e-9)
        slope = np.where(y[owner] > 0, p * (1 - total[owner]) / total[owner], -p)
        grad = -decay * len(texts) * w
        for line, feature in zip(lines, found, strict=True):
            grad += np.bincount(feature, weights=slope[line], minlength=len(w))
        g_w += grad**2
        g_b += slope.sum() ** 2
        w += rate * grad / np.sqrt(g_w)
        bias += 0.1 * rate * slope.sum() / np.sqrt(g_b)
    w[0] = 0.0
    return ToxicNet(w[place], float(bias))


class Scorer:
    def __init__(self, net: ToxicNet):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.words, self.sums = _Words(), np.zeros(0)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of every sentence, and the number of sentences of each text."""
        if self.words.full():
            self._clear()
        at, sentence, counts = self.words.bags(texts)
        if len(self.words.rows) > len(self.sums):
            new = np.array(self.words.rows[len(self.sums) :], np.int64)
            self.sums = np.r_[self.sums, self.net.weights[new].sum(1)]
        pull = self.sums[at]
        strong = np.flatnonzero(np.abs(pull) > 0)
        # a word of a sentence counts once
        pair, first = np.unique(sentence[strong] * np.int64(1 << 32) + at[strong], return_index=True)
        z = self.net.bias + np.bincount(pair >> 32, weights=pull[strong][first], minlength=int(counts.sum()))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), counts


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 4000, chars: int = 40_000_000) -> DataFrame:
    """``(h, label, text)``: whole texts of at most ``per_class`` rows of ``docs`` of each class in ``labels (key, label)``.

    Rows are chosen by a hash of key and text, smallest first; equal rows count once. A key with both labels is toxic; null
    keys, other labels and empty texts do not count. A class takes rows while their lengths add up to at most half of
    ``chars``, and passes over those that do not fit, so the result has at most that many characters. The hashes of the
    chosen rows, at most ``2 * per_class``, are broadcast to the texts.
    """
    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("lk"), F.col(label).cast("int").alias("label")).groupBy("lk").agg(F.max("label").alias("label"))
    known = cut(rows.select("k", "h", F.length("t").alias("n")).join(marks, F.col("k") == F.col("lk")).groupBy("h").agg(F.max("label").alias("label"), F.max("n").alias("n")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.shiftrightunsigned("h", 11).cast("double") * 2.0**-53
    near = known.where(share < F.when(F.col("label") == 1, 1.5 * per_class / sizes.get(1, 1)).otherwise(1.5 * per_class / sizes.get(0, 1)))
    chosen, left = [], {0: [per_class, chars // 2], 1: [per_class, chars // 2]}
    for r in sorted(near.collect(), key=lambda r: r.h % 2**64):  # about three times per_class rows of three numbers
        if left[r.label][0] and r.n <= left[r.label][1]:
            left[r.label][0] -= 1
            left[r.label][1] -= r.n
            chosen.append((r.h, r.label))
    wanted = docs.sparkSession.createDataFrame(chosen, "ch long, label int")
    return rows.join(F.broadcast(wanted), F.col("h") == F.col("ch")).groupBy("h").agg(F.first("label").alias("label"), F.first("t").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, **options) -> ToxicNet:
    """Train on the whole texts of :func:`sample`, which the driver holds. Without texts of both labels no word has a weight."""
    rows = sorted((r.h, r.label, r.text) for r in sample(docs, labels, **options).collect())
    return train([t for _, _, t in rows], [x for _, x, _ in rows])


def score(df: DataFrame, net: ToxicNet, text: str = "text", name: str = "score", spans: str | None = None, offending: float = 0.5) -> DataFrame:
    """``df`` with ``name``, the text's probability; ``spans`` names a column ``array<struct<sentence, p>>`` of sentences at ``offending`` or above.

    Sentences are numbered from 0 in their text and end at a stop, exclamation or question mark or line break. A null or
    empty text is one sentence without words. Columns of these names are replaced; others, of whatever names, are kept.
    Repeated rows are scored alike; an empty table stays empty. Whole texts are scored, however long.
    """
    kept = df.drop(name, *[spans] * bool(spans))
    place = kept.columns.index(next(c for c in kept.columns if c.lower() == text.lower()))
    names = [f"c{i}" for i in range(len(kept.columns))]
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for at, rows in portions(batch.column(place)):
                part = batch.slice(at, rows)
                p, counts = scorer.sentences(part.column(place).to_pylist())
                cols = [*part.columns, pa.array(_noisy_or(p, counts))]
                if spans:
                    first = np.cumsum(counts) - counts
                    cols.append(pa.array([[{"sentence": int(i), "p": float(p[f + i])} for i in np.flatnonzero(p[f : f + c] >= offending)] for f, c in zip(first, counts, strict=True)], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "p", "s"][: len(cols)])

    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)], StructField("p", DoubleType())])
    if spans:
        schema.add("s", ArrayType(StructType([StructField("sentence", IntegerType()), StructField("p", DoubleType())])))
    return kept.toDF(*names).mapInArrow(run, schema).toDF(*kept.columns, name, *[spans] * bool(spans))
