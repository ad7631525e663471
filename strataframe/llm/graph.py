"""Connected components by alternating large and small stars, a few shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge, the component being its smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges give an empty table. Stars are joined, never
    gathered. What a round finds is kept in the shared checkpoint folder, and so are the least neighbours before they are
    joined: both sides of each join are then dealt by Spark, which splits a node that has very many edges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    e = cut(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        least = cut(least)
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        lower = cut(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        joined = large.join(lower, F.col("u") == F.col("w"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select(F.col("w").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
