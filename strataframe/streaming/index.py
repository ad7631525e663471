"""A chunk index kept by hash bucket, whose versions share the buckets that they have in common.

``path/data/written=n/bucket=b`` holds the rows of a bucket as version ``n`` wrote them; ``path/manifest/version=n`` says for
each bucket which version wrote it. A change reads and writes the buckets it touches, and its manifest, written last, makes
it count. One writer at a time, as in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import attach_vectors, merge_chunks

ROWS = "chunk_id {key}, chunk string, embedding array<float>, embedding_model string, embedding_dimension int, is_indexed boolean, change string"
BUCKETS = 256


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of an index, oldest first."""
    at, files = _files(spark, f"{path}/manifest")
    if not files.exists(at):
        return []
    done = [s.getPath() for s in files.listStatus(at) if files.exists(_files(spark, f"{s.getPath().toString()}/_SUCCESS")[0])]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, tuple[int, str]]:
    """For each bucket that has rows: the version that wrote it and the label of that change. At most as many entries as buckets."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return {}
    rows = spark.read.parquet(f"{path}/manifest/version={known[-1] if version is None else version}").collect()
    return {r["bucket"]: (r["written"], r["label"]) for r in rows}


def _read(spark: SparkSession, path: str, entries: dict[int, tuple[int, str]], key: str) -> DataFrame:
    schema = f"{ROWS.format(key=key)}, written int, bucket int"
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/written={w}/bucket={b}" for b, (w, _) in sorted(entries.items())])


def read_index(spark: SparkSession, path: str, version: int | None = None, key: str = "bigint") -> DataFrame:
    """The rows of a version, the last by default; ``change`` is what that version did to a chunk, KEPT where it did nothing."""
    known = versions(spark, path)
    at = version if version is not None else (known[-1] if known else 0)
    rows = _read(spark, path, manifest(spark, path, version), key)
    return rows.withColumn("change", F.when(F.col("written") == at, F.col("change")).otherwise("KEPT")).drop("written", "bucket")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, label: str, touched: DataFrame, buckets: int, change) -> int | None:
    """Write the buckets whose rows ``change(old rows)`` alters, if any, and the manifest; the number of the new version.

    ``touched``: the chunk ids that may change. A label that the last version has is a repetition and does nothing.
    """
    known = versions(spark, path)
    now = manifest(spark, path)
    if label in {x for _, x in now.values()}:
        return None
    reached = [r["b"] for r in touched.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    key = touched.schema["chunk_id"].dataType.simpleString()
    old = _read(spark, path, {b: now[b] for b in reached if b in now}, key).drop("written", "bucket")
    out = change(old).withColumn("bucket", _bucket(buckets))
    altered = [r["bucket"] for r in out.groupBy("bucket").agg(F.max(F.col("change") != "KEPT").alias("any")).where("any").collect()]
    if not altered:
        return None
    number = known[-1] + 1 if known else 1
    out.where(F.col("bucket").isin(altered)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/written={number}")
    entries = {**now, **{b: (number, label) for b in altered}}
    spark.createDataFrame([(b, w, x) for b, (w, x) in sorted(entries.items())], "bucket int, written int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    return number


def merge(spark: SparkSession, path: str, new: DataFrame, model: str, dimension: int, label: str, buckets: int = BUCKETS) -> int | None:
    """Chunks ``(chunk_id, chunk)`` put into the index; a chunk that is there with the same text keeps its vector.

    Of chunks of one id the one of greatest text counts. A kept chunk is indexed if its vector is of ``model`` and
    ``dimension`` and finite; a change of that flag alone is FLAGGED. If nothing changes no version is written.
    """
    own = new.groupBy("chunk_id").agg(F.max("chunk").alias("chunk"))
    return _commit(spark, path, label, own, buckets, lambda old: merge_chunks(old, own, model, dimension, rest=True).select(*[c.split()[0] for c in ROWS.split(", ")]))


def attach(spark: SparkSession, path: str, vectors: DataFrame, model: str, dimension: int, label: str, buckets: int = BUCKETS) -> int | None:
    """Vectors ``(id, text_hash, vector)`` put on the chunks whose text still has that hash; these are VECTOR in the new version."""
    named = vectors.withColumnRenamed("id", "chunk_id")

    def change(old: DataFrame) -> DataFrame:
        out = attach_vectors(old.withColumn("_before", F.struct("embedding", "is_indexed", "embedding_model", "embedding_dimension")), vectors, model, dimension)
        same = F.struct("embedding", "is_indexed", "embedding_model", "embedding_dimension").eqNullSafe(F.col("_before"))
        return out.withColumn("change", F.when(same, "KEPT").otherwise("VECTOR")).drop("_before")

    return _commit(spark, path, label, named.select("chunk_id"), buckets, change)


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all versions but the last ``keep`` and delete the buckets that no kept one has; the number of folders deleted."""
    known = versions(spark, path)
    last = known[-max(keep, 1) :]
    used = {(w, b) for v in last for b, (w, _) in manifest(spark, path, v).items()}
    deleted = 0
    for v in known[: len(known) - len(last)]:
        at, files = _files(spark, f"{path}/manifest/version={v}")
        files.delete(at, True)
    data, files = _files(spark, f"{path}/data")
    for written in files.listStatus(data) if files.exists(data) else []:
        w = int(written.getPath().getName().removeprefix("written="))
        for bucket in files.listStatus(written.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (w, int(name.removeprefix("bucket="))) not in used and w <= max(known, default=0):
                files.delete(bucket.getPath(), True)
                deleted += 1
    return deleted
