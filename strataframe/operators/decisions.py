"""Decisions on candidates as maps of states, which compose: no candidate's log is brought into one task or one array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.tables import folder

STATES = ("PENDING", "IN_REVIEW", "VERIFIED", "REJECTED", "UNRESOLVED")
ACTIONS = ("CLAIM", "APPROVE", "EDIT_AND_APPROVE", "REJECT", "MARK_UNRESOLVED")
#: The place of any other state in a map.
OTHER = len(STATES)

_NEXT = {
    ("CLAIM", "PENDING"): ("IN_REVIEW", "APPLIED"), ("CLAIM", "IN_REVIEW"): ("IN_REVIEW", "NO_OP"), ("CLAIM", "VERIFIED"): ("VERIFIED", "NO_OP"),
    ("APPROVE", "IN_REVIEW"): ("VERIFIED", "APPLIED"), ("APPROVE", "VERIFIED"): ("VERIFIED", "NO_OP"),
    ("REJECT", "REJECTED"): ("REJECTED", "NO_OP"),
}


def next_state(state: str, action: str) -> tuple[str, str]:
    """The state after one decision, and APPLIED, NO_OP or ILLEGAL."""
    action = "APPROVE" if action == "EDIT_AND_APPROVE" else action
    if (action, state) in _NEXT:
        return _NEXT[action, state]
    if action in ("REJECT", "MARK_UNRESOLVED") and state != "VERIFIED":
        return ("REJECTED" if action == "REJECT" else "UNRESOLVED"), "APPLIED"
    return state, "ILLEGAL"


def transition(state: Column, action: Column) -> Column:
    """:func:`next_state` as a column, ``struct(state, outcome)``."""
    out = lambda s, o: F.struct(s.alias("state"), F.lit(o).alias("outcome"))
    lit = lambda s: F.lit(s)
    approve = action.isin("APPROVE", "EDIT_AND_APPROVE")
    return (
        F.when((action == "CLAIM") & (state == "PENDING"), out(lit("IN_REVIEW"), "APPLIED"))
        .when((action == "CLAIM") & state.isin("IN_REVIEW", "VERIFIED"), out(state, "NO_OP"))
        .when(approve & (state == "IN_REVIEW"), out(lit("VERIFIED"), "APPLIED"))
        .when(approve & (state == "VERIFIED"), out(state, "NO_OP"))
        .when((action == "REJECT") & (state == "REJECTED"), out(state, "NO_OP"))
        .when((action == "REJECT") & (state != "VERIFIED"), out(lit("REJECTED"), "APPLIED"))
        .when((action == "MARK_UNRESOLVED") & (state != "VERIFIED"), out(lit("UNRESOLVED"), "APPLIED"))
        .otherwise(out(state, "ILLEGAL"))
    )


def _map_of(action: str | None) -> list[int]:
    known = {s: i for i, s in enumerate(STATES)}
    return [known.get(next_state(s, action)[0], i) for i, s in enumerate((*STATES, "OTHER"))]


#: The map of each action, and last the one that changes nothing, for actions unknown.
_MAPS = np.array([*map(_map_of, ACTIONS), range(OTHER + 1)], np.int8)
#: A map is one number, its values the digits.
_DIGITS = (OTHER + 1) ** np.arange(OTHER + 1)


def _prefixes(maps: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions inside runs of equal ``segment``: each step doubles the stretch a map stands for."""
    out, step = maps, 1
    place = np.arange(len(maps)) - np.searchsorted(segment, segment)  # from the start of the run
    longest = int(place.max(initial=0))
    while step <= longest:
        later = np.flatnonzero(place >= step)
        out = out.copy()
        out[later] = np.take_along_axis(out[later], out[later - step].astype(np.int64), 1)  # the right side is read before the write
        step *= 2
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the composition of the range's earlier decisions on the same candidate, and with their own."""
    nothing = _MAPS[-1]
    last, carried, at = None, None, 0  # the candidate that the rows before ended with, and what its decisions compose to
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("id")
        code = pc.fill_null(pc.index_in(batch.column("action"), pa.array(ACTIONS)), len(ACTIONS)).to_numpy(zero_copy_only=False)
        changed = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), True).to_numpy(zero_copy_only=False)
        both_null = pc.and_(pc.is_null(key.slice(1)), pc.is_null(key.slice(0, len(key) - 1))).to_numpy(zero_copy_only=False)
        segment = np.cumsum(np.r_[False, changed & ~both_null])
        maps = _MAPS[code]
        goes_on = carried is not None and key[0].as_py() == last
        if goes_on:
            maps[0] = maps[0][carried]
        after = _prefixes(maps, segment)
        before = np.vstack([carried if goes_on else nothing, after[:-1]])
        before[np.flatnonzero(np.diff(segment)) + 1] = nothing
        last, carried = key[-1].as_py(), after[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + len(key))), pa.array((before * _DIGITS).sum(1)), pa.array((after * _DIGITS).sum(1))], names=[*batch.schema.names, "at", "before", "after"])
        at += len(key)


def fold_decisions(cands: DataFrame, decisions: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(id, seq, action, actor, previous_state, state, outcome)`` of every decision, each candidate's in order of ``seq``.

    Candidates ``(id, verification_status)`` without decisions give no row; decisions on unknown candidates are NOT_FOUND.
    Ties of ``seq`` go by action and actor; unknown actions are ILLEGAL and change nothing.

    Decisions are sorted in ranges over candidate and ``seq``, so a candidate may fill many ranges. A range is scanned once: each row
    gets the composition of the maps before it. A row for each range then tells what reaches its first candidate from the
    ranges before, and a row's state follows from three lookups. ``ranges``: their number, if Spark is not to choose it.
    """
    spark, order = decisions.sparkSession, ["id", "seq", "action", "actor"]
    rows = decisions.select("id", F.col("seq").cast("long").alias("seq"), F.col("action").cast("string").alias("action"), F.col("actor").cast("long").alias("actor"))
    kind = rows.schema["id"].dataType.simpleString()
    path = folder(spark)
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    sorted_ranges = dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sorted_ranges.mapInArrow(_scan, f"id {kind}, seq long, action string, actor long, part int, at long, before long, after long").write.parquet(path)
    scanned = spark.read.parquet(path)
    ends = scanned.groupBy("part").agg(F.min_by("id", "at").alias("first"), F.max_by("id", "at").alias("last"), F.max_by("after", "at").alias("after")).orderBy("part").collect()  # a row for each range
    reached, open_id, carried = [], None, None
    for r in ends:
        incoming = carried if carried is not None and r["first"] == open_id else _MAPS[-1]
        reached.append((r["part"], r["first"], int((incoming * _DIGITS).sum())))
        own = (r["after"] // _DIGITS % (OTHER + 1)).astype(np.int8)
        open_id, carried = r["last"], own[incoming] if r["first"] == r["last"] else own
    known = spark.createDataFrame(reached, f"_part int, _first {kind}, _reached long")
    state = F.col("_start")
    start = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0)) - 1, F.lit(OTHER)).cast("long")
    digit = lambda m, s: F.floor(m / F.pow(F.lit(OTHER + 1), s)).cast("long") % (OTHER + 1)
    joined = scanned.join(F.broadcast(known), F.col("part") == F.col("_part")).join(cands.select(F.col("id").alias("_i"), F.col("verification_status").alias("_start")), F.col("id") == F.col("_i"), "left")
    joined = joined.withColumn("_s", start).withColumn("_s", F.when(F.col("id").eqNullSafe(F.col("_first")), digit(F.col("_reached"), F.col("_s"))).otherwise(F.col("_s")))
    joined = joined.withColumn("_s", digit(F.col("before"), F.col("_s")).cast("int"))
    previous = F.when(state.isNotNull(), F.coalesce(F.get(F.array(*map(F.lit, STATES)), F.col("_s")), state))
    out = joined.withColumn("previous_state", previous).withColumn("_t", transition(F.col("previous_state"), F.col("action")))
    gone = F.col("previous_state").isNull()
    return out.select("id", "seq", "action", "actor", "previous_state", F.when(~gone, F.col("_t.state")).alias("state"), F.when(gone, "NOT_FOUND").otherwise(F.col("_t.outcome")).alias("outcome"))


def current_state(cands: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates after their decisions, with the verifier of an approval."""
    last = events.groupBy(F.col("id").alias("_i")).agg(F.max_by("state", "seq").alias("_s"), F.max(F.when((F.col("state") == "VERIFIED") & (F.col("outcome") == "APPLIED"), F.col("actor"))).alias("verified_by"))
    return cands.join(last, F.col("id") == F.col("_i"), "left").withColumn("verification_status", F.coalesce("_s", "verification_status")).drop("_i", "_s")
