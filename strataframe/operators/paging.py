"""Ordering, paging, listings and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..streaming.tables import folder


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key along ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def paginate(df: DataFrame, allowed: tuple[str, ...], order: str, key: str, page: int, size: int, descending: bool = False) -> DataFrame:
    """One page of distinct rows in a whitelisted order, ties by key, with ``total`` and ``pages`` on every row.

    Sorts for each call; for many or deep pages see :func:`keep_pages`.
    """
    if order not in allowed:
        raise ValueError(f"order by one of {', '.join(allowed)}")
    if page < 1 or not 1 <= size <= 1000:
        raise ValueError("pages start at 1 and have 1 to 1000 rows")
    rows = df.distinct()
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return rows.orderBy(by, F.col(key)).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


#: Ranges that rows are kept in for paging.
RANGES = 256


def keep_pages(df: DataFrame, allowed: tuple[str, ...], order: str, key: str, descending: bool = False, ranges: int = RANGES) -> str:
    """The folder of distinct rows kept in a whitelisted order, ties by key: sorted ranges, and a row for each with its first position.

    Sorting is done once, however many pages are read; no task holds more than a range.
    """
    if order not in allowed:
        raise ValueError(f"order by one of {', '.join(allowed)}")
    spark, path = df.sparkSession, folder(df.sparkSession)
    by = [F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), F.col(key).asc()]
    rows = df.distinct().repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    rows.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}).write.partitionBy("_range").parquet(f"{path}/rows")
    sizes = spark.read.schema(_with_place(df)).parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes.withColumn("first", before).coalesce(1).write.parquet(f"{path}/ranges")
    return path


def _with_place(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("_at", LongType()), StructField("_range", IntegerType())])


def read_page(df: DataFrame, path: str, page: int, size: int) -> DataFrame:
    """A page of what :func:`keep_pages` kept of ``df``, with ``position`` from 0, ``total`` and ``pages``; only the ranges that hold it are read.

    A page beyond the last is empty.
    """
    if page < 1 or not 1 <= size <= 1000:
        raise ValueError("pages start at 1 and have 1 to 1000 rows")
    spark, start = df.sparkSession, (page - 1) * size
    ranges = spark.read.schema("_range int, n long, first long").parquet(f"{path}/ranges").collect()  # at most as many as ranges
    total = sum(r["n"] for r in ranges)
    held = [r for r in ranges if r["first"] < start + size and r["first"] + r["n"] > start]
    rows, schema = None, _with_place(df)
    for r in held:
        inside = (F.col("_at") >= start - r["first"]) & (F.col("_at") < start + size - r["first"])
        part = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/_range={r['_range']}").where(inside).withColumn("position", F.col("_at") + r["first"])
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], StructType([*schema.fields, StructField("position", LongType())]))
    return rows.drop("_at", "_range").withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})


def list_by_status(df: DataFrame, status: str | None, newest: str, key: str, limit: int) -> DataFrame:
    """The newest rows, of one status if given."""
    rows = df.where(F.col("status") == status) if status else df
    return rows.orderBy(F.col(newest).desc(), F.col(key)).limit(limit)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... along ``order``, which should tell rows apart.

    Sorted ranges of rows are kept in the shared folder with the number of their range and their place in it; a row for each
    range tells how many rows come before it. No task holds more than a range.
    """
    part, at, path = f"_{name}_part", f"_{name}_at", folder(df.sparkSession)
    df.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id() % (1 << 33)}).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    sizes = ranged.groupBy(F.col(part).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    joined = ranged.join(F.broadcast(sizes.select("_p", before.alias("_before"))), F.col(part) == F.col("_p"))
    return joined.withColumn(name, F.col("_before") + F.col(at)).drop(part, at, "_p", "_before")


def order_pages(pages: DataFrame) -> DataFrame:
    """Pages by number, then sheet index from the metadata, then creation; missing ones last."""
    return pages.orderBy(*page_order())


def page_order() -> list[Column]:
    sheet = F.get_json_object("metadata", "$.sheet_index").try_cast("int")
    return [F.col("page_number").asc_nulls_last(), sheet.asc_nulls_last(), F.col("created_at").asc_nulls_last()]
