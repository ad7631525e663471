"""Admission of files, exact deduplication, versions, pages and scanned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_filename

MAX_BYTES = 50 * 1024 * 1024
MAX_CELLS = 1_000_000

#: Extension, MIME types, first bytes in hexadecimal, and the archive entry that an office file holds.
FORMATS = [
    ("pdf", ["application/pdf"], ["255044462D"], None),
    ("docx", ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], ["504B0304"], "word/document.xml"),
    ("xlsx", ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], ["504B0304"], "xl/workbook.xml"),
    ("xls", ["application/vnd.ms-excel", "application/msexcel"], ["D0CF11E0A1B11AE1"], None),
    ("png", ["image/png"], ["89504E470D0A1A0A"], None),
    ("jpg", ["image/jpeg"], ["FFD8FF"], None),
    ("jpeg", ["image/jpeg"], ["FFD8FF"], None),
    ("tif", ["image/tiff", "image/tif"], ["49492A00", "4D4D002A", "49492B00", "4D4D002B"], None),
    ("tiff", ["image/tiff", "image/tif"], ["49492A00", "4D4D002A", "49492B00", "4D4D002B"], None),
]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, content)`` of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def size_gate(length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """``EMPTY``, ``TOO_LARGE`` or null."""
    return F.when(F.coalesce(length, F.lit(0)) == 0, "EMPTY").when(length > max_bytes, "TOO_LARGE")


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files (name, mime, content)`` with ``safe_name``, ``status`` (ADMITTED or REJECTED) and ``reason``.

    An office archive is taken for one when its local headers name the entries it must have; its directory is not read.
    """
    formats = files.sparkSession.createDataFrame(FORMATS, "ext string, mimes array<string>, magic array<string>, entry string")
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    joined = files.withColumn("_e", ext).join(F.broadcast(formats), F.col("_e") == F.col("ext"), "left")  # nine rows
    head = F.hex(F.substring("content", 1, 8))
    mime = F.lower(F.trim(F.substring_index("mime", ";", 1)))
    content = F.decode(F.col("content"), "ISO-8859-1")
    entries = F.col("entry").isNull() | (F.contains(content, F.lit("[Content_Types].xml")) & F.contains(content, F.col("entry")))
    reason = (
        F.when(F.col("ext").isNull(), "UNSUPPORTED_EXTENSION")
        .when(~F.coalesce(F.array_contains("mimes", mime), F.lit(False)), "MIME_MISMATCH")
        .when(size_gate(F.octet_length("content"), max_bytes).isNotNull(), size_gate(F.octet_length("content"), max_bytes))
        .when(~F.exists("magic", lambda m: head.startswith(m)) | ~entries, "SIGNATURE_MISMATCH")
    )
    return joined.withColumns({"reason": reason, "safe_name": safe_filename(F.col("name"))}).withColumn("status", F.when(F.col("reason").isNull(), "ADMITTED").otherwise("REJECTED")).drop("_e", "ext", "mimes", "magic", "entry")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_by_checksum(new: DataFrame, existing: DataFrame | None = None, key: str = "id", content: str = "content", order: str = "id") -> DataFrame:
    """``new`` with ``checksum``, ``duplicate`` and ``surviving_id``: the first row of its content, the one in ``existing (id, checksum)`` before any.

    Contents are not moved for the comparison: checksums and ids alone are grouped, with partial sums, so a content that is
    repeated very often is no burden to one task.
    """
    own = new.withColumn("checksum", checksum(F.col(content)))
    first = own.groupBy(F.col("checksum").alias("_c")).agg(F.min_by(key, order).alias("_first"))
    if existing is not None:
        known = existing.groupBy(F.col("checksum").alias("_k")).agg(F.min("id").alias("_known"))
        first = first.join(known, F.col("_c") == F.col("_k"), "left").select("_c", F.coalesce("_known", "_first").alias("_first"))
    out = own.join(first, F.col("checksum") == F.col("_c"))
    return out.withColumns({"surviving_id": F.col("_first"), "duplicate": ~F.col(key).eqNullSafe(F.col("_first"))}).drop("_c", "_first")


def latest_version(versions: DataFrame) -> DataFrame:
    """The row of the highest version number of each document."""
    w = Window.partitionBy("document_id").orderBy(F.col("version_number").desc())
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_pages(pages: DataFrame, path: str) -> None:
    """Replace all rows of the versions in ``pages``, and no other version's."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_version_id").parquet(path)


def needs_ocr(text: Column, min_chars: int = 20) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) < min_chars


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of ``words (page, block, par, line, word, text, conf, left, top, width, height)`` with text, confidence from 0 to 1 and box; blank words are dropped."""
    rows = words.where(F.trim("text") != "")
    out = rows.groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, 4).alias("confidence"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    return out


def ocr_pages(lines: DataFrame) -> DataFrame:
    """Page text and the mean of the lines' confidences."""
    order = F.struct("block", "par", "line", "text")
    return lines.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "\n").alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"))


def grid_guard(cells: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``(table_id, n_rows, n_columns, allowed)``."""
    size = cells.groupBy("table_id").agg((F.max("row_index") + 1).cast("long").alias("n_rows"), (F.max("column_index") + 1).cast("long").alias("n_columns"))
    return size.withColumn("allowed", F.col("n_rows") * F.col("n_columns") <= max_cells)
