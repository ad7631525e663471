"""Faults that only larger tables show, on small ones."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataframe.operators import chunk, extract
from strataframe.operators.decisions import ACTIONS, next_state
from strataframe.plans import publication, review


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_headers_and_titles_are_not_broadcast(spark):
    cells = spark.range(3).select(F.col("id").alias("table_id"), F.inline(F.array(*[F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), F.lit(v).alias("raw_value")) for r, row in enumerate((("Production in 2020-21 (kt)", ""), ("State", "Coking coal"), ("Odisha", "1,250"))) for c, v in enumerate(row)])))
    defined = spark.range(1).select(F.col("id").alias("table_id"))
    out = extract.production_rows(cells, defined)
    assert _broadcasts(out) == 2  # the table of units, for tables and for cells
    assert [(r["table_id"], r["commodity"], float(r["normalized_value"])) for r in out.orderBy("table_id").collect()] == [(t, "Odisha — Coking coal", 1_250_000.0) for t in range(3)]
    assert _broadcasts(extract.table_rows(cells)) == 0
    assert _broadcasts(extract.cell_context(cells)) == 0
    named = cells.withColumns({"normalized_value": F.lit(None).cast("string"), "table_order": F.lit(1)})
    assert _broadcasts(chunk.table_row_text(named)) == 0


def test_names_of_more_than_four_digits_stay_different(spark, tmp_path):
    spark.createDataFrame([(1025, 1), (10251, 1), (10252, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(10251,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in review.identity(spark, str(tmp_path)).select("id", "entity_id").collect()] == [(10251, 10251)]


@pytest.mark.parametrize("years", [6, 0])
def test_streamed_decisions_are_all_there(spark, tmp_path, years):
    """Over six years, which a last decision 90 days later does not let the watermark pass; and with times that do not rise."""
    first = datetime(2020, 1, 1, tzinfo=UTC)
    ts = [first + timedelta(days=i * 365 * years // 64) if years else first + timedelta(days=i * 7 % 16) for i in range(64)]
    spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(ts)], "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = publication.stream_states(spark, str(tmp_path)).where("id >= 0").collect()
    expected, state = [], {}
    for i in range(64):
        key, action = i % 3 * 7, ACTIONS[(i * 31 + i % 3) % 5]
        state[key], outcome = next_state(state.get(key, "PENDING"), action)
        expected.append((key, i, action, state[key], outcome))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
