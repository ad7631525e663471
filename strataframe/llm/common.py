"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable in the folder of ``spark.checkpoint.dir``.

    Only a session that runs on one machine (``local``) may leave that unset: it gets a folder of its own.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataframe-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, stem: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_folder` named, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def kept(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written once as compressed columns in the shared folder; for tables too large for ``cut``."""
    path = new_folder(df.sparkSession, stem)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that a task no longer needs back to the machine; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def portions(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and number of rows of stretches of about ``size`` bytes of text, one row at least, however long texts are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + size // 4096)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop - at
        at = stop


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(key: str, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... along ``order`` within each group, without bringing a group or a key into one task.

    Rows are sorted in ranges over group, order and, last, their place in the input, so that rows of one key, too, fill as
    many ranges as they need; rows that ``order`` does not tell apart are numbered in any order. The ranges are kept in the
    shared folder; a row for each range tells how many rows come before it, and a row for each group where it begins. An
    empty table stays empty.
    """
    tie, part, at, number, before = (fresh(df, x) for x in ("tie", "part", "at", "number", "before"))
    path = new_folder(df.sparkSession, "ranges")
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*group, *order, tie).drop(tie)
    ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id() % (1 << 33)}).write.parquet(path)
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(part, IntegerType()), StructField(at, LongType())])).parquet(path)
    sizes = rows.groupBy(F.col(part).alias(f"{part}r")).agg(F.count(F.lit(1)).alias(before))
    earlier = F.coalesce(F.sum(before).over(Window.partitionBy(F.lit(0)).orderBy(f"{part}r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    numbered = rows.join(sizes.select(f"{part}r", earlier.alias(before)), F.col(part) == F.col(f"{part}r")).withColumn(number, F.col(before) + F.col(at)).drop(part, at, f"{part}r", before)
    first = numbered.groupBy(*[F.col(g).alias(f"{before}{i}") for i, g in enumerate(group)]).agg(F.min(number).alias(before))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{before}{i}"))
    return numbered.join(first, same).withColumn(name, (F.col(number) - F.col(before)).cast("long")).drop(number, before, *[f"{before}{i}" for i in range(len(group))])
