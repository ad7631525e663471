from pyspark.sql import functions as F

from strataframe.operators import chunk

SCHEMA = "table_id long, table_order int, row_index int, column_index int, raw_value string, normalized_value string"


def test_rows_of_odd_tables(spark):
    cells = [
        (1, 1, 0, 0, "Mine ", None), (1, 1, 0, 1, "", ""), (1, 1, 1, 1, "7", None), (1, 1, 1, 0, " A", "B"), (1, 1, 1, 2, None, None),  # a column without a heading
        (2, 3, 4, 0, "alone", None),  # one row
        (3, 1, 2, 0, "x", None), (3, 1, 2, 0, "y", None), (3, 1, 3, 0, "v", None), (3, 1, 3, 0, "u", None),  # two cells at one place
        (4, 1, 0, 0, "h", None), (4, 2, 1, 0, "a", None), (4, 2, 0, 1, "k", None),  # one table in two places
    ]
    got = {(r.table_id, r.row_index, r.text) for r in chunk.table_row_text(spark.createDataFrame(cells, SCHEMA)).collect()}
    assert got == {
        (1, 1, "Table 1, row 2. Headers: Mine | Column 2. Mine: B | Column 2: 7 | Column 3: "),
        (2, 4, "Table 3, row 5. Headers: alone. alone: alone"),
        (3, 3, "Table 1, row 4. Headers: y | y. y: u | y: v"),
        (4, 1, "Table 2, row 2. Headers: h | k. h: a"),
    }


def test_cells_are_dealt_out_once_and_not_joined(spark):
    """Cells were dealt out and sorted for the headers and again for the rows, and these were joined."""
    cells = spark.range(100).select(F.col("id").alias("table_id"), F.lit(1).alias("table_order"), F.lit(0).alias("row_index"), F.lit(0).alias("column_index"), F.lit("a").alias("raw_value"), F.lit(None).cast("string").alias("normalized_value"))
    plan = chunk.table_row_text(cells)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Range") == 1
