"""Exact links by Jaccard similarity inside groups of texts that may be near-duplicates.

Groups come from elsewhere and only have to be large enough: any two texts to be linked are in one group. A group whose
shingles fit in a task is linked there. In a larger one every text is first compared with the group's first text; only those
that do not link with it are compared with all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, portions, release_memory
from .shingles import shingle_set

#: Shingles that a task compares with each other at once (8 bytes each, a few copies).
BLOCK = 1_000_000


class _Sets:
    """Shingle sets of a task, to be compared one with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.size) - self.size
        self.filled = np.flatnonzero(self.size)
        values, self.where = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.seen = np.zeros(len(values), np.int32)

    def near(self, i: int, percent: int) -> np.ndarray:
        """Whether each set has ``percent`` hundredths of its union with set ``i`` in common; two empty sets are equal."""
        mine = self.where[self.first[i] : self.first[i] + self.size[i]]
        both = np.zeros(len(self.size), np.int64)
        if len(self.filled):
            self.seen[mine] = 1
            both[self.filled] = np.add.reduceat(self.seen[self.where], self.first[self.filled])
            self.seen[mine] = 0
        return (100 + percent) * both >= percent * (self.size + self.size[i])


def forest(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Index pairs that connect exactly what is connected by pairs of at least ``percent`` similarity."""
    held, a, b, left = _Sets(sets), [], [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            i = front.pop()
            new = np.flatnonzero(left & held.near(i, percent)).tolist()
            a += [i] * len(new)
            b += new
            left[new] = False
            front += new
    return a, b


def bridges(sets: list[np.ndarray], percent: int, side: np.ndarray) -> tuple[list[int], list[int]]:
    """For each set of side 0 that is similar to one of side 1, such a pair."""
    held, a, b = _Sets(sets), [], []
    for i in np.flatnonzero(side == 0).tolist():
        new = np.flatnonzero(held.near(i, percent) & (side == 1))[:1].tolist()
        a += [i] * len(new)
        b += new
    return a, b


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts (node, text)`` with ``hashes``, their shingle sets, instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in portions(batch.column(1)):
                part = batch.slice(at, rows)
                sets = [shingle_set(t, shingle).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])
        release_memory()

    return texts.mapInArrow(run, "node long, hashes array<long>")


def _in_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` inside each task of ``rows (task, side, node, hashes)``: all that connects, or, in tasks with a side 1, one for each node of side 0."""

    def linked(nodes: list[int], sets: list[np.ndarray], sides: list[int]) -> pa.RecordBatch:
        a, b = bridges(sets, percent, np.array(sides)) if any(sides) else forest(sets, percent) if len(nodes) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sets, sides = None, [], [], []
        for batch in batches:
            hashes = batch.column(3)
            ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (t, side, node) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                if t != task:
                    if nodes:
                        yield linked(nodes, sets, sides)
                    task, nodes, sets, sides = t, [], [], []
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
                sides.append(side)
        if nodes:
            yield linked(nodes, sets, sides)
        release_memory()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what ``percent`` similarity connects inside the groups of ``members (group, node, hashes)``.

    ``members`` is read several times and should be a kept table, one row a node. A large group costs one comparison a
    node, and for each node that is not similar to the group's first one all others.
    """
    sizes = kept(members.groupBy("group").agg(F.sum(F.size("hashes") + 1).alias("total"), F.min("node").alias("lead")), "groups")
    own = members.join(sizes.withColumnRenamed("group", "g"), F.col("group") == F.col("g")).drop("g")
    out = _in_tasks(own.where(F.col("total") <= BLOCK).select(F.col("group").alias("task"), _side(0), "node", "hashes"), percent)
    if sizes.where(F.col("total") > BLOCK).isEmpty():
        return out
    large = own.where(F.col("total") > BLOCK)
    leads = kept(large.where(F.col("node") == F.col("lead")).select(F.col("group").alias("g"), F.col("hashes").alias("led")), "leads")
    both = F.size(F.array_intersect("hashes", "led"))
    near = F.lit(100 + percent) * both >= F.lit(percent) * (F.size("hashes") + F.size("led"))
    blocks = F.ceil(F.col("total") * 2 / BLOCK).cast("int").alias("blocks")
    compared = kept(large.join(leads, F.col("group") == F.col("g")).select("group", "node", "lead", "hashes", blocks, near.alias("near")), "compared")
    rest = compared.where(~F.col("near"))
    parts = F.ceil(F.sum(F.size("hashes") + 1) * 2 / BLOCK).cast("int").alias("parts")
    parts = kept(rest.groupBy("group").agg(parts).withColumnRenamed("group", "g"), "parts")
    rest, like = (x.join(parts, F.col("group") == F.col("g")) for x in (rest, compared.where("near")))
    far = rest.withColumns({"x": _part("parts"), "y": F.explode(_to("blocks"))})
    like = like.withColumns({"y": _part("blocks"), "x": F.explode(_to("parts"))})
    task = F.xxhash64("group", "x", "y").alias("task")
    across = far.select(task, _side(0), "node", "hashes").unionByName(like.select(task, _side(1), "node", "hashes"))
    inner = rest.withColumns({"x": _part("parts"), "y": F.explode(_to("parts"))})
    inner = inner.select(F.xxhash64("group", F.lit(-1), F.least("x", "y"), F.greatest("x", "y")).alias("task"), _side(0), "node", "hashes")
    out = out.unionByName(compared.where("near").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    return out.unionByName(_in_tasks(across, percent)).unionByName(_in_tasks(inner, percent))


def _side(n: int) -> Column:
    return F.lit(n).cast("byte").alias("side")


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")


def _to(n: str) -> Column:
    return F.sequence(F.lit(0), F.col(n) - 1)
