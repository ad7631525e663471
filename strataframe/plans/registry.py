"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, extraction, production, publication, review, search, spatial, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (production, spatial, text, documents, search, extraction, review, publication)


def queries() -> dict[str, Query]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
