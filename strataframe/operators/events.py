"""Audit and review events as one log, and unions of trusted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_events(audit: DataFrame, reviews: DataFrame) -> DataFrame:
    """Both logs with their details as JSON: ``(source, event_id, ts, actor, action, detail)``.

    ``audit (event_id, ts, actor, action, details)``, ``reviews (event_id, ts, actor, action, candidate_id, previous_state, new_state)``.
    """
    a = audit.select(F.lit("AUDIT").alias("source"), "event_id", "ts", "actor", "action", F.col("details").alias("detail"))
    r = reviews.select(F.lit("VERIFICATION").alias("source"), "event_id", "ts", "actor", "action", F.to_json(F.struct("candidate_id", "previous_state", "new_state")).alias("detail"))
    return a.unionByName(r)


def newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), "source", F.col("event_id").desc()).limit(n)


def union_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables under one schema, with their names as ``entity_type``; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("entity_type", F.lit(name)) for name, df in tables.items()])


def activity(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events of each action in windows of time."""
    return events.groupBy(F.window("ts", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "n")
