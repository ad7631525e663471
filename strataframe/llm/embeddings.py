"""Embedding near-duplicates by collision counting.

Vectors are projected on many random lines and each projection is sorted; a pair collides on a line when one lies in the
window centred on the other. The width of the windows and the count that a pair has to reach are set from the recall wanted
for pairs at the cosine bound, and pairs that reach it are verified in double precision. So that no window spans the whole
table, lines are sorted inside cells: ``tables`` times, vectors are dealt by the signs of ``bits`` other projections, as many
tables as the recall needs. (In 64 dimensions a window at a cosine of 0.95 holds a third of all vectors, so collisions over
the whole table would be all pairs.) Copies are compared once. A task counts the links it finds for each vector and passes
on the counts and a spanning forest, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept
from .graph import connected_components
from .simhash import spanning_forest

#: Members of a cell that a task compares with each other; larger cells are dealt out in blocks.
BLOCK = 1024
LINES = 24


def calibrate(bound: float, dim: int, recall: float, lines: int = LINES) -> tuple[float, int]:
    """Half-width of the windows and least count, for unit vectors at the bound to pass with probability ``recall``.

    Coordinates of a pair's difference along a random unit line are near normal with deviation ``distance / sqrt(dim)``.
    """
    half = 1.5 * math.sqrt(2 * (1 - bound)) / math.sqrt(dim)
    p = math.erf(1.5 / math.sqrt(2))
    tail, count = 0.0, 0
    for k in range(lines + 1):  # the largest count that is reached often enough
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > 1 - recall:
            count = k
            break
    return half, count


def cells(n: int, bound: float, recall: float, size: int = 192) -> tuple[int, int]:
    """Sign bits for cells of about ``size`` of ``n`` vectors, and tables for a pair at the bound to share a cell with ``recall``."""
    bits = max(2, math.ceil(math.log2(n / size))) if n > size else 0
    if not bits:
        return 0, 1
    same = (1 - math.acos(bound) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _signs(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers, one column a table."""
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    on = (x @ planes > 0).reshape(len(x), -1, bits)
    return (on << np.arange(bits)).sum(2).astype(np.int64)


def collisions(projected: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` of rows whose projections lie within ``half`` on at least ``least`` lines."""
    s = len(projected)
    counts = np.zeros(s * s, np.uint8)
    for line in range(projected.shape[1]):
        order = np.argsort(projected[:, line], kind="stable")
        v = projected[order, line]
        reach = np.searchsorted(v, v + half, "right") - np.arange(s) - 1  # those above, inside the window
        a = np.repeat(np.arange(s), reach)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach)
        i, j = order[a], order[b]
        counts[np.minimum(i, j) * s + np.maximum(i, j)] += 1  # a pair occurs once a line
    return np.divmod(np.flatnonzero(counts >= max(least, 1)), s)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(v, node, size)`` for one row of each different usable vector: its least key and number of rows; null keys have no node."""
    v = _values(df, vector)
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("v").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("size"))


def _values(df: DataFrame, vector: str) -> Column:
    """The vector as it is stored where that is in single precision, else in double."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    return F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))


def links(nodes: DataFrame, bound: float = 0.95, recall: float = 0.9995, seed: int = 5) -> DataFrame:
    """``(a, b, n)`` for ``nodes (v, node, size)``: links ``(a, b, null)`` that connect what all links found do, and ``(a, null, n)`` rows that sum to the rows linked with each node.

    Vectors of another length than the most frequent do not link with those of that length, but among themselves.
    """
    out = None
    for r in nodes.groupBy(F.size("v").alias("dim")).count().collect():  # as many rows as there are vector lengths
        found = _links_of(nodes.where(F.size("v") == r["dim"]), r["dim"], r["count"], bound, recall, seed)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else nodes.sparkSession.createDataFrame([], "a long, b long, n long")


def _links_of(nodes: DataFrame, dim: int, n: int, bound: float, recall: float, seed: int) -> DataFrame:
    rng = np.random.default_rng(seed)
    half, least = calibrate(bound, dim, recall)
    bits, tables = cells(n, bound, recall)
    lines = rng.normal(size=(dim, LINES))
    lines /= np.linalg.norm(lines, axis=0)
    planes = rng.normal(size=(dim, tables * max(bits, 1)))

    def matrix(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(1, keepdims=True)  # neither over- nor underflows below
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _signs(matrix(batch.column(1)), planes, bits) * tables + np.arange(tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables)), pa.array(cell.ravel())], names=["node", "cell"])

    dealt = nodes.select("node", "v").mapInArrow(deal, "node long, cell long")
    blocks = dealt.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("c", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    tasks = dealt.join(blocks, F.col("cell") == F.col("c")).select("node", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("node", "cell", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = tasks.join(nodes, "node").select(F.xxhash64("cell", "x", "y").alias("task"), "cell", F.when(F.col("x") != F.col("y"), F.col("own")).otherwise(-1).alias("side"), "node", "size", "v")

    def pairs(task: np.ndarray, cell: np.ndarray, side: np.ndarray, node: np.ndarray, size: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], ...]:
        """Ends of a forest's links, and nodes with the rows they link with."""
        signs = _signs(x, planes, bits)
        projected = x @ lines
        got: tuple[list[np.ndarray], ...] = ([], [], [], [])
        first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(task)], strict=True):
            if e - s < 2:
                continue
            i, j = collisions(projected[s:e], half, least)
            i, j = i + s, j + s
            table = int(cell[s]) % tables
            keep = (side[i] < 0) | (side[i] != side[j])  # two blocks: pairs of one block have their own task
            keep &= ~(signs[i, :table] == signs[j, :table]).any(1)  # an earlier table has the pair
            i, j = i[keep], j[keep]
            near = np.einsum("nd,nd->n", x[i], x[j]) >= bound
            i, j, n = i[near] - s, j[near] - s, e - s
            linked = np.bincount(i, size[s + j], n) + np.bincount(j, size[s + i], n)
            if len(i) > n:
                whole = np.zeros((n, n), bool)
                whole[i, j] = whole[j, i] = True
                i, j = (np.array(k, np.int64) for k in spanning_forest(whole))
            some = np.flatnonzero(linked)
            for column, value in zip(got, (node[s + i], node[s + j], node[s + some], linked[some].astype(np.int64)), strict=True):
                column.append(value)
        return got

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _then_none(batches):
            if batch is None:
                if rest is None:
                    return
                now, rest = rest, None
            else:
                now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                task = now.column(0).to_numpy()
                end = int(np.flatnonzero(task == task[-1])[0])
                now, rest = now.slice(0, end), now.slice(end)
            if not now.num_rows:
                continue
            cols = [now.column(i).to_numpy() for i in range(5)]
            a, b, node, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in pairs(*cols, matrix(now.column(5).combine_chunks())))
            out = pa.table({"a": np.r_[a, node], "b": pa.concat_arrays([pa.array(b), pa.nulls(len(node), pa.int64())]), "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n)])})
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(verify, "a long, b long, n long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", bound: float = 0.95, recall: float = 0.9995) -> DataFrame:
    """``(key, n_links, component, kept)`` for every row of ``df``.

    ``n_links`` counts the other rows linked directly, copies included; ``component`` is the smallest key reachable over
    links, the row's own included; ``kept`` says whether they are equal. Vectors that are null, empty, zero or hold a null
    or non-finite number link with nothing, not even their copies. A null key links with nothing and has a null component.
    An empty table gives an empty result; other columns play no part. Pairs at the bound are found with a probability of
    about ``recall`` and nearer ones more often; no pair below it is linked.
    """
    groups = kept(usable(df, key, vector), "vectors")
    found = cut(links(groups, bound, recall))
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = groups.join(counts, F.col("node") == F.col("a"), "left").join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
    known = kept(known.select("v", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "node").alias("part")), "linked")
    rows = df.select(F.col(key).alias("key"), F.when(F.col(key).isNotNull(), _values(df, vector)).alias("w"))
    out = rows.join(known, F.col("w") == F.col("v"), "left")
    return out.select(F.col("key"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", F.col("key").cast("long")).alias("component")).withColumn("kept", F.col("component").eqNullSafe(F.col("key").cast("long")))
