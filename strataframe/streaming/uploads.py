"""Uploads accepted once for each content, over all time: nothing is forgotten, so nothing waits in the stream's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import checksum
from .index import _files

#: Hexadecimal digits of a checksum that name its part of the table.
DIGITS = 2


def _known(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(checksum, id, batch, prefix)`` of every content accepted so far."""
    at, files = _files(spark, f"{path}/known")
    schema = f"checksum string, id {key}, prefix string, batch long"
    return spark.read.schema(schema).parquet(f"{path}/known") if files.exists(at) else spark.createDataFrame([], schema)


def accept(spark: SparkSession, path: str, files: DataFrame, batch: int, key: str = "id", content: str = "content", order: str = "ts") -> None:
    """One batch: ``path/uploads/batch=n`` gets ``(key, checksum, surviving_id, duplicate)`` of every file, ``path/known`` the contents that are new.

    A content that an earlier batch has is a duplicate of the file accepted then; of a batch's own files of one content the
    first by ``order``, then by key, is accepted. A batch that is repeated ignores and overwrites what it wrote before. Only
    the parts of the table that the batch's checksums fall in are read. Null contents are duplicates of each other.
    """
    digest = F.coalesce(checksum(F.col(content)), F.lit("0" * 64))
    rows = files.select(F.col(key).alias("id"), F.col(order).alias("o"), digest.alias("checksum"))
    kind = rows.schema["id"].dataType.simpleString()
    first = rows.groupBy("checksum").agg(F.min(F.struct("o", "id")).alias("m")).select("checksum", F.col("m.id").alias("first"), F.substring("checksum", 1, DIGITS).alias("prefix"))
    prefixes = [r["prefix"] for r in first.select("prefix").distinct().collect()]  # at most 16 to the number of digits
    earlier = _known(spark, path, kind).where(F.col("prefix").isin(prefixes) & (F.col("batch") < batch)).select(F.col("checksum").alias("k"), F.col("id").alias("known"))
    winners = first.join(earlier, F.col("checksum") == F.col("k"), "left").select("checksum", "prefix", "known", F.coalesce("known", "first").alias("surviving_id"))
    judged = rows.join(winners.select(F.col("checksum").alias("c"), "surviving_id"), F.col("checksum") == F.col("c"))
    judged.select(F.col("id").alias(key), "checksum", "surviving_id", (~F.col("id").eqNullSafe(F.col("surviving_id"))).alias("duplicate")).write.mode("overwrite").parquet(f"{path}/uploads/batch={batch}")
    new = winners.where(F.col("known").isNull()).select("checksum", F.col("surviving_id").alias("id"), "prefix", F.lit(batch).cast("long").alias("batch"))
    new.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(f"{path}/known")


def stream_uploads(files: DataFrame, path: str, checkpoint: str, key: str = "id", content: str = "content", order: str = "ts") -> StreamingQuery:
    """:func:`accept` for every batch of a stream; batches are numbered by the stream, so a restart repeats the one it was in."""
    return files.writeStream.foreachBatch(lambda batch, n: accept(batch.sparkSession, path, batch, n, key, content, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def uploads(spark: SparkSession, path: str, key: str = "id", kind: str = "bigint") -> DataFrame:
    """All uploads judged so far."""
    return spark.read.schema(f"{key} {kind}, checksum string, surviving_id {kind}, duplicate boolean, batch long").parquet(f"{path}/uploads")
