"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, regions have racks, racks have shards with weights; an inner node weighs what its shards weigh. A
row descends three levels. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the
child's path, and the smallest draw wins, so children get rows in proportion to weight. A child's draw depends on nothing
but its own path and weight: when one shard's weight changes, rows move only into or out of the subtrees that contain it.
:func:`grow` adds a shard as a region of its own, so that a larger tree takes rows into the new shard only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, gapless_rank

Tree = list[list[list[float]]]


def uniform_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """A tree of equal weights; shards are numbered from left to right."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    racks = [[1.0] * min(per_rack, shards - i) for i in range(0, shards, per_rack)]
    return [racks[i : i + racks_per_region] for i in range(0, len(racks), racks_per_region)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, the last, in a region of its own."""
    return [*tree, [[weight]]]


def _draw(weight: Column, *path: Column) -> Column:
    """An exponential draw with the given rate; a node of no weight never wins."""
    u = (F.shiftrightunsigned(F.xxhash64(*path), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _winner(draws: list[Column]) -> Column:
    return F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("child")) for i, d in enumerate(draws)]))["child"]


def _pick(values: list[float | int], at: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at + 1)


def with_shard(df: DataFrame, key: str, tree: Tree, name: str, seed: int = 7) -> DataFrame:
    """Add ``name``, the number of the shard that the tree gives each row. Null keys descend together as one key."""
    wide, deep = max(len(r) for r in tree), max(len(k) for r in tree for k in r)
    weight = [[[k[s] if s < len(k) else 0.0 for s in range(deep)] for k in [*r, *[[]] * (wide - len(r))]] for r in tree]
    numbers, n = [], 0
    for r in tree:
        for k in [*r, *[[]] * (wide - len(r))]:
            numbers += [n + s if s < len(k) else -1 for s in range(deep)]
            n += len(k)
    region, rack, leaf = (fresh(df, f"{name}_{x}") for x in ("region", "rack", "leaf"))
    own = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    out = df.withColumn(region, _winner([_draw(F.lit(sum(map(sum, w))), own, F.lit(seed), F.lit(i)) for i, w in enumerate(weight)]))
    out = out.withColumn(rack, _winner([_draw(_pick([sum(w[j]) for w in weight], F.col(region), "double"), own, F.lit(seed), F.col(region), F.lit(j)) for j in range(wide)]))
    path = F.col(region) * wide + F.col(rack)
    out = out.withColumn(leaf, _winner([_draw(_pick([w[j][s] for w in weight for j in range(wide)], path, "double"), own, F.lit(seed), F.col(region), F.col(rack), F.lit(s)) for s in range(deep)]))
    return out.withColumn(name, _pick(numbers, path * deep + F.col(leaf), "int")).drop(region, rack, leaf)


def shard(df: DataFrame, key: str = "doc_id", tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the shard under ``grown``).

    Rows with equal keys go to one shard and get different slots. Texts play no part. Rows with a null key go to one
    shard. An empty table stays empty. Columns of these three names in ``df`` are replaced; all others are kept.
    """
    tree = tree or uniform_tree(40)
    df = df.drop("shard", "slot", "grown_shard")
    placed = with_shard(with_shard(df, key, tree, "shard"), key, grown or grow(tree), "grown_shard")
    return gapless_rank(placed, ["shard"], [key], "slot")


def balance(sharded: DataFrame, size: str) -> DataFrame:
    """Rows, bytes and moved rows of each shard."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"), F.count(F.when(F.col("shard") != F.col("grown_shard"), 1)).alias("n_moved"))


def leaves(tree: Tree) -> int:
    return reduce(lambda n, r: n + sum(len(k) for k in r), tree, 0)
