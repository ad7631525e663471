"""Data of reports: validation, sections, citations, findings, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intel
from .paging import latest
from .terms import ranked_terms


def validate_reports(reports: DataFrame, sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(report_id, status, problems)``: required sections, unique and known citations, evidence with provenance, no values in insufficient sections.

    ``reports (report_id, required array<string>)``, ``sections (report_id, title, status, text, n_items, citations array<string>)``,
    ``evidence (report_id, citation_id, document_id, chunk_id)``.
    """
    have = sections.groupBy("report_id").agg(F.collect_set("title").alias("titles"), F.max(F.when(F.col("status") != "COMPLETED", F.col("status"))).alias("worst"))
    missing = reports.join(have, "report_id", "left").where(F.size(F.array_except("required", F.coalesce("titles", F.array().cast("array<string>")))) > 0).select("report_id", F.lit("MISSING_SECTION").alias("problem"))
    repeated = evidence.groupBy("report_id", "citation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("report_id", F.lit("CITATION_NOT_UNIQUE").alias("problem"))
    cited = sections.select("report_id", F.explode("citations").alias("citation_id")).distinct()
    unknown = cited.join(evidence.select("report_id", "citation_id").distinct(), ["report_id", "citation_id"], "left_anti").select("report_id", F.lit("CITATION_UNKNOWN").alias("problem"))
    bare = evidence.where("document_id IS NULL OR chunk_id IS NULL").select("report_id", F.lit("EVIDENCE_WITHOUT_PROVENANCE").alias("problem"))
    valued = sections.where(F.col("status").startswith("INSUFFICIENT") & ((F.col("n_items") > 0) | F.coalesce(F.col("text").rlike(r"\d"), F.lit(False)))).select("report_id", F.lit("VALUE_IN_INSUFFICIENT_SECTION").alias("problem"))
    problems = missing.unionByName(repeated).unionByName(unknown).unionByName(bare).unionByName(valued).groupBy("report_id").agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    joined = reports.select("report_id").join(problems, "report_id", "left").join(have.select("report_id", "worst"), "report_id", "left")
    status = F.when(F.size(F.coalesce("problems", F.array().cast("array<string>"))) > 0, "VALIDATION_FAILED").when(F.col("worst").isNotNull(), "INSUFFICIENT_DATA").otherwise("COMPLETED")
    return joined.select("report_id", status.alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def cite(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """``(term, citations)``: each term's evidence chunks by their labels ``(chunk_id, citation_id)``, in order."""
    each = evidence.select("term", F.posexplode("evidence").alias("at", "e")).select("term", "at", F.col("e.chunk_id").alias("chunk_id"))
    joined = each.join(labels, "chunk_id")
    return joined.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "citation_id"))), lambda x: x["citation_id"]).alias("citations"))


def document_report(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """``(section, term, frequency, citations)``: topics and keywords with the labels of their evidence, labels given in order of first use."""
    themes, words = ranked_terms(chunks, limit, (True, False))
    every = [("topics", *x) for x in themes] + [("keywords", *x) for x in words]
    rows = chunks.sparkSession.createDataFrame(every, "section string, term string, frequency long")  # ``limit`` rows of each
    ev = intel.evidence(chunks, rows)
    ev = chunks.sparkSession.createDataFrame(ev.collect(), ev.schema)  # five chunks a term at most, used twice
    first = ev.select(F.explode("evidence").alias("e")).select(F.col("e.document_id").alias("document_id"), F.col("e.chunk_id").alias("chunk_id")).distinct()
    labels = first.withColumn("citation_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("document_id", "chunk_id")))).select("chunk_id", "citation_id")  # five chunks a term at most
    return rows.join(cite(ev, labels), "term", "left")


def comparison_report(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """``(class, n_topics, first_topics)`` of a comparison of documents."""
    rows = intel.compare_documents(chunks, limit)
    w = Window.partitionBy("class").orderBy(F.col("total").desc(), "term")
    top = rows.withColumn("r", F.row_number().over(w))
    return top.groupBy("class").agg(F.count(F.lit(1)).alias("n_topics"), F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "term")))), lambda x: x["term"]).alias("first_topics"))


def executive_report(production_rows: DataFrame, layer_counts: DataFrame, features: DataFrame, limit: int = 100) -> DataFrame:
    """``(section, key, value)``: production by section and key, layers with their counts, and how many of the first features there are."""
    p = production_rows.select("section", "key", F.col("value").cast("double").alias("value"))
    l = layer_counts.select(F.lit("layers").alias("section"), F.col("entity_type").alias("key"), F.col("n").cast("double").alias("value"))
    f = features.orderBy("entity_type", "id").limit(limit).groupBy("entity_type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("features").alias("section"), F.col("entity_type").alias("key"), "value")
    return p.unionByName(l).unionByName(f)


def report_sources(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("report_id").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"), F.sort_array(F.collect_set("document_version_id")).alias("version_ids"))


def reference_summary(evidence: DataFrame, pages: int = 8) -> DataFrame:
    """``(report_id, document_id, pages, n_trusted)``: the first pages of each document as text, the rest as ``+n more``."""
    each = evidence.groupBy("report_id", "document_id").agg(F.sort_array(F.collect_set("page_number")).alias("_p"), F.count(F.when(F.col("evidence_type") == "TRUSTED_CANONICAL_DATA", 1)).alias("n_trusted"))
    more = F.when(F.size("_p") > pages, F.concat(F.lit(" +"), F.size("_p") - pages, F.lit(" more"))).otherwise("")
    return each.select("report_id", "document_id", F.concat(F.array_join(F.slice("_p", 1, pages).cast("array<string>"), ", "), more).alias("pages"), "n_trusted")


def findings(items: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` numeric fields of ``items (report_id, item_index, fields map<string,string>, citations)``, with the other fields as dimensions."""
    each = items.select("report_id", "item_index", "fields", "citations", F.explode("fields").alias("field", "value"))
    numeric = each.where(F.col("value").try_cast("decimal(38,9)").isNotNull())
    w = Window.partitionBy("report_id").orderBy("item_index", "field")
    first = numeric.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    dims = F.map_filter("fields", lambda k, v: v.try_cast("decimal(38,9)").isNull())
    return first.select("report_id", "rank", "field", "value", F.to_json(dims).alias("dimensions"), "citations")


def appendix_evidence(evidence: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of ``evidence (report_id, position, topic)``: one for each topic first, then in order."""
    one = Window.partitionBy("report_id", "topic").orderBy("position")
    rows = evidence.withColumn("_tier", F.when(F.col("topic").isNotNull() & (F.row_number().over(one) == 1), 0).otherwise(1))
    w = Window.partitionBy("report_id").orderBy("_tier", "position")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_tier")


__all__ = ["appendix_evidence", "cite", "comparison_report", "document_report", "executive_report", "findings", "latest", "reference_summary", "report_sources", "validate_reports"]
