"""Writers: append-only tables, new rows alone, spreadsheets' CSV, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_safe


def csv_safe(df: DataFrame) -> DataFrame:
    """Every text column made safe for spreadsheets."""
    return df.select(*[formula_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    csv_safe(df).write.option("header", True).mode("error").csv(path)


def append_only(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add rows to a table of events or history; anything but appending is refused."""
    if mode != "append":
        raise ValueError("events and history are append-only")
    df.write.mode("append").parquet(path)


def new_rows(df: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not there yet; a repeated id is taken once."""
    return df.dropDuplicates([key]).join(existing.select(F.col(key).alias("_have")), F.col(key) == F.col("_have"), "left_anti")


def append_new(df: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows that a table does not have; running twice adds nothing."""
    from pyspark.errors import AnalysisException

    try:
        existing = df.sparkSession.read.parquet(path)
    except AnalysisException:
        df.dropDuplicates([key]).write.parquet(path)
        return
    new_rows(df, existing, key).write.mode("append").parquet(path)


def write_report(sections: DataFrame, path: str) -> None:
    """Sections as JSON lines, a folder for each report."""
    sections.write.partitionBy("report_id").mode("error").json(path)


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features as lines of text."""
    features.select(F.col("feature_json").alias("value")).write.mode("error").text(path)
