"""Best-fit packing from fitted patterns.

Only the histogram of piece lengths, one number for each length up to the capacity, reaches the driver. Patterns of two to four
lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and what is left over is packed best fit, longest first, on the histogram too. Each length's places are
then given out by rank: the r-th piece of a length takes the r-th place for that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank
from .tokens import encoded, encoder


def pieces(df: DataFrame, vocabulary: str, end: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)``, and ``ids`` if asked for: every text's ids with ``end`` after them, cut where longer than ``capacity``.

    All pieces of a cut text but the first are full. A null text counts as empty: it is one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, True)
        for batch in batches:
            for at, ids, n in encoded(batch.column(1), e, end):
                k = -(-n // capacity)
                own = np.repeat(np.arange(len(n)), k)
                number = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
                first = n - (k - 1) * capacity
                start = np.where(number == 0, 0, first[own] + (number - 1) * capacity)
                length = np.where(number == 0, first[own], capacity)
                place = np.repeat(np.cumsum(n) - n, k) + start
                wide = memoryview(np.ascontiguousarray(ids.astype("<u4")))
                crc = [zlib.crc32(wide[a : a + c]) for a, c in zip(place.tolist(), length.tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(own + at)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])
        e.forget()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(present: np.ndarray, capacity: int, seconds: int = 24) -> list[tuple[int, ...]]:
    """Multisets of two to four present lengths that fill ``capacity``, or come as near as the present lengths allow."""
    under = np.zeros(capacity + 1, np.int64)  # the largest present length up to each
    under[present] = present
    under = np.maximum.accumulate(under)
    spread = np.unique(present[np.linspace(0, len(present) - 1, min(seconds, len(present))).astype(int)])
    out: set[tuple[int, ...]] = set()
    for a in present[present < capacity].tolist():
        firsts = [(a,), (a, a), (a, a, a), *((a, int(b)) for b in spread), *((a, a, int(b)) for b in spread[::3])]
        for f in firsts:
            left = capacity - sum(f)
            if left > 0 and (last := int(under[left])):
                out.add(tuple(sorted((*f, last), reverse=True)))
    return sorted(out)


def fit(columns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts ``x >= 0`` of least ``|A x - histogram|``, by accelerated projected gradients; A counts lengths in patterns."""
    row = np.array([v for c in columns for v in c], np.int64)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    forward = lambda x: np.bincount(row, weights=x[col], minlength=len(histogram))
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(columns))
    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(forward(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1.0 / (1.02 * max(float(v @ back(forward(v))), 1e-9))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: ``(lengths, how many such sequences)``. Equal sequences are handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the space left
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s in open_ if s >= length), default=None)
            if space is None:
                per = capacity // length
                for size, times in ((per, n // per), (n % per, 1)):
                    if size and times:
                        open_.setdefault(capacity - size * length, []).append(((length,) * size, times))
                n = 0
            else:
                group, times = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                used = min(n, times)
                if times > used:
                    open_.setdefault(space, []).append((group, times - used))
                open_.setdefault(space - length, []).append(((*group, length), used))
                n -= used
    return [g for groups in open_.values() for g in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, how many such sequences)`` that together hold exactly ``histogram[length]`` pieces of each length."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    present = np.flatnonzero(left)
    columns = patterns(present, capacity) if len(present) else []
    if columns:
        x = np.floor(fit(columns, left.astype(float))).astype(np.int64)
        for i in sorted(np.flatnonzero(x).tolist(), key=lambda i: (capacity - sum(columns[i]), len(columns[i]), i)):
            if sum(columns[i]) < capacity - capacity // 256:
                continue  # the rest packs these better
            need = [(v, len(list(g))) for v, g in groupby(columns[i])]
            times = min(int(x[i]), *(int(left[v]) // k for v, k in need))
            if times:
                out.append((columns[i], times))
                for v, k in need:
                    left[v] -= k * times
    return out + best_fit(left, capacity)


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, rank after the last, sequence of the first rank, offset)`` for every place of every pattern."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in planned:
        offset = 0
        for v in lengths:
            at = given.get(v, 0)
            out.append((v, at, at + times, sequence, offset))
            given[v] = at + times
            offset += v
        sequence += times
    return out


def pack(df: DataFrame, vocabulary: str, end: int, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of :func:`pieces` with ``sequence_id`` and ``offset``; places in a sequence are gapless from 0.

    Every row of ``df`` is packed, repeated keys and texts included; null texts are empty texts. An empty table gives an
    empty result. The table of places has at most a few times ``capacity`` squared rows whatever the input, and is
    broadcast. Only ``key`` and ``text`` of ``df`` are used.
    """
    own = cut(pieces(df, vocabulary, end, capacity, key, text, with_ids))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in own.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    table = df.sparkSession.createDataFrame(places(plan(histogram, capacity)), "l long, lo long, hi long, base long, offset long")
    ranked = gapless_rank(own, ["length"], ["key", "piece", "start"], "rank")
    out = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids)
