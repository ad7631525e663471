"""Exact interpolated quantiles of groups of any size.

A group of at most ``limit`` rows is one aggregate. In a larger one the values wanted are selected: a sketch of the values
that are still in question gives a range around the rank, exact counts tell how many values lie below and inside it, and
only the range that holds the rank goes on. A round leaves some thousandths of the values, so few rounds do for any group;
what is left at the end is counted by value. The sketch only proposes: whatever it says, the counts decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.tables import folder

#: Rows of a group, or values in question, that one task may hold.
LIMIT = 1 << 20
#: Ranges of the sketch and its accuracy: ranks are within a ten-thousandth.
RANGES, ACCURACY = 1024, 10_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_values(df: DataFrame, value: str | Column, keys: tuple[str, ...]) -> DataFrame:
    """``(k0, k1, ..., v)``: keys and value of each row, the value as it is, written once to the shared folder."""
    return kept(df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], (F.col(value) if isinstance(value, str) else value).alias("v")))


def _same(n: int, prefix: str = "_k") -> Column:
    on = F.lit(True)
    for i in range(n):
        on = on & F.col(f"k{i}").eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def quantiles(rows: DataFrame, n_keys: int, probabilities: list[float], limit: int = LIMIT) -> DataFrame:
    """``(k0, ..., q)`` for each group of ``rows (k0, ..., v)``: ``q`` has the interpolated value at each probability, null for a group without values.

    ``rows`` should be kept: they are read several times where a group is larger than ``limit``.
    """
    keys = [f"k{i}" for i in range(n_keys)]
    rows = rows.select(*keys, F.col("v").cast("double").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("v").alias("n"))
    small = lambda df: df.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q"))
    if not sizes.where(F.col("n") > limit).limit(1).count():
        return small(rows)
    large = kept(sizes.where(F.col("n") > limit).select(*[F.col(k).alias(f"_{k}") for k in keys], "n"))
    position = F.col("p") * (F.col("n") - 1)
    wanted = large.select("*", F.explode(F.array(*map(F.lit, probabilities))).alias("p")).select("*", F.explode(F.array(F.floor(position), F.ceil(position))).alias("rank"))
    ends = rows.where(F.col("v").isNotNull()).join(large, _same(n_keys)).groupBy(*[f"_{k}" for k in keys]).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = wanted.select(*[f"_{k}" for k in keys], "rank", F.col("n").alias("inside")).distinct()
    targets = targets.join(ends.select(*[F.col(f"_{k}").alias(k) for k in keys], "lo", "hi"), _same(n_keys)).drop(*keys).withColumn("below", F.lit(0).cast("long"))
    state = kept(targets.select(*[f"_{k}" for k in keys], "rank", "lo", "hi", "below", "inside"))
    of = [*[f"_{k}" for k in keys], "rank"]

    def in_question(targets: DataFrame) -> DataFrame:
        return rows.join(targets, _same(n_keys) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

    while state.where((F.col("inside") > limit) & (F.col("lo") < F.col("hi"))).limit(1).count():
        open_, done = state.where((F.col("inside") > limit) & (F.col("lo") < F.col("hi"))), state.where((F.col("inside") <= limit) | (F.col("lo") >= F.col("hi")))
        grid = F.array(*[F.lit(i / RANGES) for i in range(RANGES + 1)])
        sketch = in_question(open_).groupBy(*of, "lo", "hi", "below", "inside").agg(F.percentile_approx("v", grid, ACCURACY).alias("cuts"))
        at = F.floor((F.col("rank") - F.col("below")) * RANGES / F.col("inside")).cast("int")
        ranged = kept(sketch.select(*of, "lo", "hi", "below", "inside", F.get("cuts", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("cuts", F.least(at + 2, F.lit(RANGES))).alias("b")))
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        parts = (("under", v < a), ("first", v == a), ("between", (v > a) & (v < b)), ("last", (v == b) & (a < b)), ("over", v > b))
        counts = in_question(ranged).groupBy(*of, "below").agg(*[F.struct(F.count(F.when(c, 1)).alias("n"), F.min(F.when(c, v)).alias("lo"), F.max(F.when(c, v)).alias("hi")).alias(name) for name, c in parts])
        below, side = F.col("below"), None  # the part that holds the rank; every part but the whole has fewer different values
        for name, _ in parts:
            part = F.struct(F.col(f"{name}.lo").alias("lo"), F.col(f"{name}.hi").alias("hi"), below.alias("below"), F.col(f"{name}.n").alias("inside"))
            below = below + F.col(f"{name}.n")
            side = F.when(F.col("rank") < below, part) if side is None else side.when(F.col("rank") < below, part)
        nearer = counts.select(*of, side.alias("s")).select(*of, "s.lo", "s.hi", "s.below", "s.inside")
        state = kept(done.unionByName(nearer))
    by_value = in_question(state).groupBy(*of, "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*of).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = by_value.withColumn("upto", F.sum("c").over(upto) + F.col("below")).where(F.col("upto") > F.col("rank")).groupBy(*of).agg(F.min("v").alias("found"))
    found = kept(found.select(*[F.col(f"_{k}").alias(k) for k in keys], F.col("rank").alias("r"), "found"))
    ranks = wanted.select(*[f"_{k}" for k in keys], "p", "n", "rank").distinct()
    values = ranks.join(found, _same(n_keys) & (F.col("rank") == F.col("r"))).drop(*keys, "r")
    lower, upper = F.min("found"), F.max("found")
    whole = F.floor(position)
    per = values.groupBy(*[f"_{k}" for k in keys], "p", "n").agg(lower.alias("a"), upper.alias("b")).withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((whole + 1 - position) * F.col("a") + (position - whole) * F.col("b")))
    picked = per.groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("p", "x"))).alias("m"))  # one entry for each probability
    picked = picked.select(*keys, F.array(*[F.element_at("m", F.lit(p)) for p in probabilities]).alias("q"))
    rest = rows.join(large, _same(n_keys), "left_anti")
    return small(rest).unionByName(picked) if n_keys else picked
