"""Tables as streams, and folders for what streams write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one only where a session on one machine names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataframe-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{shared(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files; a stream reads folders alone."""
    path = f"{sf_dir}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
