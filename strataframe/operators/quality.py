"""Quality rules as rows: table, rule, key, severity, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def confidence(column: str = "confidence") -> Rule:
    return "confidence_range", F.col(column).isNull() | F.col(column).between(0, 1)


def nonnegative(column: str) -> Rule:
    return f"{column}_nonnegative", F.col(column).isNull() | (F.col(column) >= 0)


def positive(column: str) -> Rule:
    return f"{column}_positive", F.col(column).isNull() | (F.col(column) > 0)


def production() -> list[Rule]:
    """A mine or a project, and a period that does not end before it starts."""
    return [("entity_required", F.col("mine_id").isNotNull() | F.col("project_id").isNotNull()), ("period_order", F.col("period_end").isNull() | F.col("period_start").isNull() | (F.col("period_end") >= F.col("period_start")))]


def geology() -> list[Rule]:
    v = F.col("value").cast("double")
    return [("top_nonnegative", F.col("top").isNull() | (F.col("top") >= 0)), ("interval_order", F.col("bottom").isNull() | (F.col("bottom") >= F.col("top"))), ("depth_nonnegative", F.col("depth").isNull() | (F.col("depth") >= 0)), ("value_finite", v.isNull() | (~F.isnan(v) & (F.abs(v) < float("inf"))))]


def one_of(column: str, values: tuple[str, ...]) -> Rule:
    return f"{column}_known", F.col(column).isNull() | F.col(column).isin(*values)


def violations(df: DataFrame, table: str, key: str, rules: list[Rule], severity: str = "ERROR") -> DataFrame:
    """``(table, rule, key, status, severity, message)`` for every rule that a row breaks; one pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return df.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("FAILED").alias("status"), F.lit(severity).alias("severity")).withColumn("message", F.concat("table", F.lit("."), "rule", F.lit(" is broken")))


def duplicates(df: DataFrame, table: str, keys: list[str], severity: str = "ERROR") -> DataFrame:
    """Keys that occur more than once."""
    rule = "unique_" + "_".join(keys)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.lit("FAILED").alias("status"), F.lit(severity).alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("message"))


def quality_report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
