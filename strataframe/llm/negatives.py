"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each half has a codebook, and a pair of codewords is a cell. No member of a cell scores higher
with a query than the query's scores with the two codewords plus, for each half, the norm of the query's half times the
codeword's radius (the distance of the farthest member). For each query a heap visits cells by falling sum of these two half
bounds (the multi-sequence walk). A search asks for the best ``k`` rows of a window of scores, of the query's label or of
other labels, in two rounds: the first walks until it has seen some thousand rows, whose ``k``-th best score in the window
is a floor; the second walks on until the next cell's bound is below that floor. What is left cannot hold a better row, so
the window is certified, and the result is exact whatever codebooks a sample gives.

Rows are packed by cell, and large cells are cut into blocks by a hash of the key; queries are sent to the blocks that they visit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept

#: Rows of a packed block, and queries that are sent to it together.
BLOCK, QUERIES = 4096, 128
#: Rows of the sample that the codebooks are fitted on, about; never twice as many.
SAMPLE = 8192
#: Rows that the first round of a search looks at for each query, at least.
PROBE = 2048
#: Bounds of windows that are open to one side.
LEAST, MOST = -(1 << 62), 1 << 62
#: Whole numbers below this are exact in double precision.
_EXACT = float(1 << 53)


@dataclass
class Index:
    """Codebooks of both halves with their radii, and the number of rows of each cell; at most ``codes`` squared cells."""

    dim: int
    books: list[np.ndarray]
    radii: list[np.ndarray]
    rows: dict[tuple[int, int], int]
    exact: bool
    width: np.dtype  # of packed components
    block: int

    def parts(self, cell: tuple[int, int]) -> int:
        """The number of blocks that a cell's rows are dealt to."""
        return -(-self.rows[cell] // self.block)

    def half(self, x: np.ndarray, side: int) -> np.ndarray:
        return x[:, : self.dim // 2] if side == 0 else x[:, self.dim // 2 :]

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: what a member of a codeword can score at most and at least, with room for rounding."""
        out = []
        for side in (0, 1):
            q = self.half(queries.astype(np.float64), side)
            mid, wide = q @ self.books[side].T, np.sqrt((q * q).sum(1, keepdims=True)) * self.radii[side]
            room = 1e-9 * (np.abs(mid) + wide) + 1e-6
            out.append((mid + wide + room, mid - wide - room))
        return out


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """All pairs of codewords by falling sum of their bounds."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield a[i], b[j], -bound
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def _codebook(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from randomly chosen different rows."""
    different = np.unique(x, axis=0)
    book = different[rng.choice(len(different), min(codes, len(different)), replace=False)]
    for _ in range(rounds):
        code = _nearest(x, book)
        count = np.bincount(code, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, code, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * (x @ book.T)).argmin(1)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as zero beyond their end."""
    values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; in doubles where every sum is exact there, else in Python's integers."""
    if exact:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


def build(rows: DataFrame, codes: int | None = None, sample: int = SAMPLE, seed: int = 3) -> tuple[Index | None, DataFrame | None]:
    """The index of ``rows (id, label, vector)`` and its packed blocks ``(cell, part, ids, labels, vectors)``; none of an empty table.

    ``codes``: codewords of a half; by default the fourth root of the number of rows, from 4 to 256. The codebooks are fitted
    on a sample of about ``sample`` rows, chosen by a hash; all rows are indexed.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("top")).first()
    if not seen["n"]:
        return None, None
    dim, n, top = max(seen["dim"], 2), seen["n"], seen["top"] or 0
    codes = codes or int(np.clip(round(n**0.25), 4, 256))
    share = F.shiftrightunsigned(F.xxhash64("id", "vector"), 11).cast("double") * 2.0**-53
    drawn = rows.where(share * n < sample).select("vector").limit(2 * sample).toArrow()
    drawn = drawn if drawn.num_rows else rows.select("vector").limit(1).toArrow()
    index = Index(dim, [], [], {}, dim * float(top) ** 2 < _EXACT, np.dtype(np.int16 if top < 1 << 15 else np.int64), BLOCK)
    x = _matrix(drawn.column("vector").combine_chunks(), dim).astype(np.float64)
    rng = np.random.default_rng(seed)
    index.books = [_codebook(index.half(x, side), codes, rng) for side in (0, 1)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("vector"), dim)
            out = [batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in whole.astype(index.width)], pa.binary())]
            for side in (0, 1):
                half = index.half(whole.astype(np.float64), side)
                code = _nearest(half, index.books[side])
                out += [pa.array(code.astype(np.int32)), pa.array(np.sqrt(((half - index.books[side][code]) ** 2).sum(1)))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "label", "vector", "i", "di", "j", "dj"])

    dealt = kept(rows.select("id", "label", "vector").mapInArrow(assign, "id long, label long, vector binary, i int, di double, j int, dj double"), "cells")
    cells = dealt.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("di").alias("di"), F.max("dj").alias("dj"))
    index.radii = [np.zeros(len(b)) for b in index.books]
    for r in cells.collect():  # at most codes squared rows
        index.rows[r["i"], r["j"]] = r["n"]
        for side, (code, d) in enumerate(((r["i"], r["di"]), (r["j"], r["dj"]))):
            index.radii[side][code] = max(index.radii[side][code], d)
    parts = F.broadcast(rows.sparkSession.createDataFrame([(*c, index.parts(c)) for c in index.rows], "ci int, cj int, parts long"))  # bounded likewise
    other = len(index.books[1])
    placed = dealt.join(parts, (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj"))).select((F.col("i") * other + F.col("j")).alias("cell"), F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int").alias("part"), "id", "label", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, part = (batch.column(c).to_numpy() for c in ("cell", "part"))
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]).tolist() if len(cell) else []
            ranges = [(a, min(a + index.block, b)) for lo, b in zip(cuts, [*cuts[1:], len(cell)], strict=True) for a in range(lo, b, index.block)]
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            packed = [[ids[a:b].tobytes() for a, b in ranges], [labels[a:b].tobytes() for a, b in ranges], [b"".join(batch.column("vector").slice(a, b - a).to_pylist()) for a, b in ranges]]
            starts = [a for a, _ in ranges]
            yield pa.RecordBatch.from_arrays([pa.array(cell[starts], pa.int32()), pa.array(part[starts], pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names=["cell", "part", "ids", "labels", "vectors"])

    ordered = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
    return index, kept(ordered.mapInArrow(pack, "cell int, part int, ids binary, labels binary, vectors binary"), "blocks")


def _visits(asked: DataFrame, index: Index, same: bool, certify: bool, probe: int) -> DataFrame:
    """The queries, packed for each block that they visit in this round."""
    other = len(index.books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                yield from _packed(batch.slice(at, QUERIES))

    def _packed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, ids, labels = (part.column(c).to_numpy() for c in ("query", "id", "label"))
        x = _matrix(part.column("vector"), index.dim)
        windows = part.column("windows").to_pylist()
        (up1, low1), (up2, low2) = index.bounds(x)
        wanted: dict[int, list[int]] = {}
        for q, own in enumerate(windows):
            floor, most, seen = min(w["floor"] for w in own), max(w["high"] for w in own), 0
            for i, j, bound in walk(up1[q], up2[q]):
                if bound < floor or (not certify and seen >= probe):
                    break
                size = index.rows.get((i, j), 0)
                if size and low1[q, i] + low2[q, j] <= most:
                    if not certify or seen >= probe:  # what the first round has seen is not seen again
                        wanted.setdefault(i * other + j, []).append(q)
                    seen += size
        out: list[tuple] = []
        for cell, qs in wanted.items():
            at = np.array([[q, w["w"], w["low"], w["high"], w["floor"]] for q, i in enumerate(qs) for w in windows[i]], np.int64)
            row = (query[qs].tobytes(), ids[qs].tobytes(), labels[qs].tobytes(), x[qs].astype(index.width).tobytes(), at.tobytes())
            out += [(cell, p, *row) for p in range(index.parts(divmod(cell, other)))]
            if len(out) >= 64:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["c", "p", "query", "id", "label", "vector", "windows"])

    return asked.mapInArrow(run, "c int, p int, query binary, id binary, label binary, vector binary, windows binary")


def _look(visits: DataFrame, blocks: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """``(query, w, other, score)``: of each block visited the best rows of every window.

    Both sides are packed: they are larger than Spark takes them for, so neither may be broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                query, own, label, ids, labels = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("query", "id", "label", "ids", "labels"))
                queries, rows = (np.frombuffer(batch.column(c)[r].as_py(), index.width).reshape(-1, index.dim) for c in ("vector", "vectors"))
                score = _products(queries, rows, index.exact)
                fine = ((labels == label[:, None]) == same) & (ids != own[:, None])
                at = np.frombuffer(batch.column("windows")[r].as_py(), np.int64).reshape(-1, 5)
                s = score[at[:, 0]]
                w, other = np.nonzero(fine[at[:, 0]] & (s >= np.maximum(at[:, 2], at[:, 4])[:, None]) & (s <= at[:, 3][:, None]))
                s = s[w, other]
                order = np.lexsort((ids[other], -s, w))
                w, other, s = w[order], other[order], s[order]
                first = np.searchsorted(w, w)  # where each window's rows begin
                best = np.arange(len(w)) - first < k
                w, other, s = w[best], other[best], s[best]
                yield pa.RecordBatch.from_arrays([pa.array(query[at[w, 0]]), pa.array(at[w, 1]), pa.array(ids[other]), pa.array(s)], names=["query", "w", "other", "score"])

    met = visits.join(blocks.hint("merge"), (F.col("c") == F.col("cell")) & (F.col("p") == F.col("part"))).drop("c", "p", "cell", "part")
    return met.mapInArrow(run, "query long, w long, other long, score long")


def search(asked: DataFrame, index: Index, blocks: DataFrame, same: bool, k: int, probe: int = PROBE) -> DataFrame:
    """``(query, w, other, score, rank)``: the best ``k`` rows of each window of ``asked (query, id, label, vector, windows)``.

    ``windows``: an array of ``(w, low, high)``. Rows have the query's label or not, as ``same`` says, and never its id;
    higher scores come first, ties by smaller id.
    """
    ranked = Window.partitionBy("query", "w").orderBy(F.desc("score"), "other")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    open_ = asked.withColumn("windows", F.transform("windows", lambda w: w.withField("floor", w["low"])))
    first = kept(best(_look(_visits(open_, index, same, False, probe), blocks, index, same, k)), "probed")
    floors = first.where(F.col("rank") == k).groupBy(F.col("query").alias("q")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))  # one entry for each window
    raised = open_.join(floors, F.col("query") == F.col("q"), "left").withColumn("windows", F.transform("windows", lambda w: w.withField("floor", F.coalesce(F.try_element_at("floors", w["w"]), w["low"])))).drop("q", "floors")
    rest = _look(_visits(raised, index, same, True, probe), blocks, index, same, k)
    return best(first.drop("rank").unionByName(rest))


def mine(rows: DataFrame, anchor: Column, key: str = "id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, codes: int | None = None, probe: int = PROBE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for every row where ``anchor`` holds.

    ``vector`` holds whole numbers, ``label`` is a whole number, scores are inner products. An anchor's positives are its
    ``positives`` best rows of its label. For each the ``negatives`` best rows of other labels are returned whose score lies
    between ``low`` and ``high`` hundredths of the positive's; a positive of negative score has none. Ties go by smaller key.

    Rows with a null key, label, vector or component take no part. A row of the anchor's own key is never its partner;
    repeated rows are partners as often as they occur, and repeated anchors answer once. Shorter vectors count as zero beyond
    their end. An empty table, or one without anchors, gives no rows. Other columns play no part. Positives'
    scores beyond 2^56 raise, because the bounds of their windows do not fit a long.
    """
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False)) & F.col(key).isNotNull() & F.col(label).isNotNull()
    usable = rows.where(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    index, blocks = build(usable.drop("is_anchor"), codes)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    anchors = kept(usable.where("is_anchor").drop("is_anchor").distinct().withColumns({"query": F.monotonically_increasing_id(), "windows": everything}), "anchors")
    near = kept(search(anchors, index, blocks, True, positives, probe), "positives")
    between = F.struct(F.col("rank").cast("long").alias("w"), F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"))
    windows = near.where("score >= 0").groupBy(F.col("query").alias("q")).agg(F.collect_list(between).alias("asked"))  # at most ``positives`` entries
    asked = anchors.drop("windows").join(windows, F.col("query") == F.col("q")).drop("q").withColumnRenamed("asked", "windows")
    found = search(asked, index, blocks, False, negatives, probe)
    ends = near.select(F.col("query").alias("q"), F.col("rank").cast("long").alias("positive"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(ends, (F.col("query") == F.col("q")) & (F.col("w") == F.col("positive"))).drop("q").join(anchors.select(F.col("query").alias("q"), F.col("id").alias("anchor_id")), F.col("query") == F.col("q"))
    return named.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
