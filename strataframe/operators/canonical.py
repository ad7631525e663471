"""Publication of verified candidates: records, entities, facts, value history and data conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import normalize_point
from ..functions.text import entity_key, uuid5
from .extract import NAMESPACE, parse_pair
from .review import resolve_identity

# What has a table of its own, and the names of the coordinate system.
PUBLISHABLE = ("MINE", "PROJECT", "BOREHOLE", "COAL_BLOCK", "GEOLOGICAL_FORMATION", "SEAM", "GEOLOGICAL_MEASUREMENT", "PRODUCTION", "COORDINATE")
WGS84 = ("EPSG:4326", "4326", "WGS84", "WGS 84")


def canonical_records(cands: DataFrame, approvals: DataFrame) -> DataFrame:
    """One record for each approved candidate: what was found, what was accepted, who verified it.

    ``approvals (id, verified_by, verified_seq, edited map<string,string>)``; without an edit the candidate's own values are accepted.
    """
    a = approvals.groupBy(F.col("id").alias("_i")).agg(F.min_by(F.struct("verified_by", "verified_seq", "edited"), "verified_seq").alias("_a"))
    joined = cands.join(a, F.col("id") == F.col("_i"))
    edited = F.col("_a.edited")
    pick = lambda c: F.coalesce(F.element_at(edited, c), F.col(c).cast("string"))
    original = F.struct("raw_value", "normalized_value", "unit")
    return joined.withColumns({"original": original, "accepted_value": pick("normalized_value"), "accepted_unit": pick("unit"), "edited_flag": edited.isNotNull(), "verified_by": F.col("_a.verified_by"), "verification_id": uuid5(F.lit(NAMESPACE), F.concat_ws("|", F.lit("record"), F.col("id").cast("string")))}).drop("_i", "_a")


def upsert_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of ``records (id, entity_type, name)`` that ``entities (entity_type, entity_key)`` lack: one for each type and key, named by its first record."""
    rows = records.withColumn("entity_key", entity_key(F.col("name"))).where("entity_key <> ''")
    new = rows.join(entities.select(F.col("entity_type").alias("_t"), F.col("entity_key").alias("_k")), (F.col("entity_type") == F.col("_t")) & (F.col("entity_key") == F.col("_k")), "left_anti")
    first = new.groupBy("entity_type", "entity_key").agg(F.min_by("name", "id").alias("canonical_name"), F.min("id").alias("created_by"))
    return first.withColumn("entity_id", uuid5(F.lit(NAMESPACE), F.concat_ws("|", "entity_type", "entity_key")))


def publish_gate(cands: DataFrame) -> DataFrame:
    """``reason`` why a candidate ``(verification_status, classification, mapping_status, verified_by, actor, role)`` is not published; null if it is."""
    return cands.withColumn("reason", (
        F.when(F.col("verification_status") != "VERIFIED", "NOT_VERIFIED")
        .when(F.col("classification").isin("UNKNOWN", "UNRESOLVED", "CONFLICT") | F.col("mapping_status").isin("POSSIBLE_MATCH", "CONFLICT", "UNRESOLVED"), "NEEDS_HUMAN_RESOLUTION")
        .when(~F.coalesce(F.col("role").isin("ADMIN", "VERIFIER"), F.lit(False)), "ROLE_REQUIRED")
        .when(~F.coalesce(F.col("verified_by") == F.col("actor"), F.lit(False)), "OTHER_VERIFIER")
        .when(F.col("mapping_status") != "APPROVED", "MAPPING_NOT_APPROVED")
        .when(~F.col("classification").isin(*PUBLISHABLE), "NO_DOMAIN_MAPPING")
    ))


def publish_entities(cands: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities, and known ones with the names of matched candidates as aliases; known values do not change.

    ``cands (id, name, code, parent, lat, lon)``; ``entities`` as for :func:`..review.resolve_identity`.
    """
    found = resolve_identity(cands, entities).withColumnRenamed("id", "_i")
    joined = cands.join(found, F.col("id") == F.col("_i"))
    new = joined.where("identity_status = 'NEW'").withColumn("entity_key", entity_key(F.col("name"))).groupBy("entity_key").agg(F.min_by("name", "id").alias("canonical_name"), F.min("id").alias("created_by"), F.count(F.lit(1)).alias("n_candidates"))
    names = joined.where("identity_status = 'MATCHED'").groupBy(F.col("entity_id").alias("_e")).agg(F.sort_array(F.collect_set("name")).alias("_names"))
    kept = entities.join(names, F.col("entity_id") == F.col("_e"), "left")
    fresh = F.array_except(F.coalesce("_names", F.array().cast("array<string>")), F.array("canonical_name"))
    return new, kept.withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), fresh)).drop("_e", "_names")


def check_refs(facts: DataFrame, dims: DataFrame, column: str, key: str) -> DataFrame:
    """``facts`` whose ``column`` names a row that is not in ``dims``; null names nothing."""
    return facts.where(F.col(column).isNotNull()).join(dims.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def publish_facts(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Facts with ``reason``: MISSING and the names of required columns that are null, else null."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return records.withColumn("reason", F.when(F.size(missing) > 0, F.concat(F.lit("MISSING "), F.array_join(missing, ","))))


def _with_known(facts: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """``reason`` of facts without one whose reference, by its column, is no row of the trusted table ``(column)``; null names nothing."""
    for column, trusted in refs.items():
        known = trusted.select(F.col(column).alias("_known")).distinct()
        joined = facts.join(known, F.col(column) == F.col("_known"), "left")
        unknown = F.col("reason").isNull() & F.col(column).isNotNull() & F.col("_known").isNull()
        facts = joined.withColumn("reason", F.when(unknown, F.lit(f"UNKNOWN {column}")).otherwise(F.col("reason"))).drop("_known")
    return facts


def publish_measurements(records: DataFrame, **refs: DataFrame) -> DataFrame:
    """Measurement facts; ``refs`` name trusted tables by the columns that refer to them (``borehole_id``, ``seam_id``)."""
    return _with_known(publish_facts(records, ("value", "unit")), refs)


def publish_production(records: DataFrame, **refs: DataFrame) -> DataFrame:
    """Production facts; ``refs`` name trusted tables by the columns that refer to them (``mine_id``, ``project_id``)."""
    return _with_known(publish_facts(records, ("value", "unit", "period")), refs)


def publish_coordinates(records: DataFrame, accepted: str | None = None) -> DataFrame:
    """Points in WGS84 with their canonical text; others have a ``reason``.

    A declared ``crs`` has to be one of its names; none declared is taken for it. The column ``accepted`` holds the text
    that was accepted: where a pair can be read from it, that pair counts, else ``lat`` and ``lon``.
    """
    p = normalize_point(F.col("lat"), F.col("lon"))
    if accepted is not None:
        pair = parse_pair(F.coalesce(F.col(accepted), F.lit("")))
        p = F.when(pair.isNotNull(), normalize_point(pair["lat"].cast("string"), pair["lon"].cast("string"))).otherwise(p)
    crs = F.upper(F.trim(F.coalesce("crs", F.lit(""))))
    return records.withColumns({"point": p, "reason": F.when((crs != "") & ~crs.isin(*WGS84), "CRS_UNSUPPORTED").when(p.isNull(), "INVALID_POINT")})


def fold_values(values: DataFrame) -> DataFrame:
    """``values (entity_type, entity_id, field, seq, value)`` with ``outcome``: APPENDED while the field is new or equal to the last accepted value, else CONFLICT with ``against``.

    A conflict does not replace the accepted value, so every value is compared with the first of its field.
    """
    w = Window.partitionBy("entity_type", "entity_id", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("value").over(w)
    return values.withColumn("against", first).withColumn("outcome", F.when(F.col("value").eqNullSafe(F.col("against")), "APPENDED").otherwise("CONFLICT"))


def value_history(values: DataFrame) -> DataFrame:
    return fold_values(values).where("outcome = 'APPENDED'").drop("against", "outcome")


def value_conflicts(values: DataFrame) -> DataFrame:
    return fold_values(values).where("outcome = 'CONFLICT'").select("entity_type", "entity_id", "field", "seq", F.col("against").alias("value_a"), F.col("value").alias("value_b"), F.lit("OPEN").alias("status"))


def already_published(cands: DataFrame, trusted: list[DataFrame], history: DataFrame) -> DataFrame:
    """``cands`` with ``published``: in a trusted table, or in the history unless they are coordinates, which need their row."""
    rows = reduce(DataFrame.unionByName, [t.select("source_candidate_id") for t in trusted]).distinct().withColumnRenamed("source_candidate_id", "_t")
    past = history.select(F.col("source_candidate_id").alias("_h")).distinct()
    joined = cands.join(rows, F.col("id") == F.col("_t"), "left").join(past, F.col("id") == F.col("_h"), "left")
    return joined.withColumn("published", F.col("_t").isNotNull() | (F.col("_h").isNotNull() & (F.col("classification") != "COORDINATE"))).drop("_t", "_h")


def missing_trusted(cands: DataFrame, trusted: DataFrame) -> DataFrame:
    """Verified coordinates without a trusted row."""
    return cands.where("verification_status = 'VERIFIED' AND classification = 'COORDINATE'").join(trusted.select(F.col("source_candidate_id").alias("_t")), F.col("id") == F.col("_t"), "left_anti")


def backfill_coordinates(cands: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(outcome, n)``: coordinates that a backfill creates, that it fails on, and that are there already."""
    todo = publish_coordinates(missing_trusted(cands, trusted)).select(F.when(F.col("reason").isNull(), "CREATED").otherwise("FAILED").alias("outcome"))
    have = cands.where("verification_status = 'VERIFIED' AND classification = 'COORDINATE'").join(trusted.select(F.col("source_candidate_id").alias("_t")), F.col("id") == F.col("_t"), "left_semi").select(F.lit("SKIPPED").alias("outcome"))
    return todo.unionByName(have).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def field_provenance(history: DataFrame, records: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """History rows with their record and, where known, document and page."""
    return history.join(records, "verification_id").join(documents, "document_id", "left").join(pages, "page_id", "left")


def resolve_data_conflicts(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Statuses after ``resolutions (conflict_id, resolution)``; settled conflicts do not change."""
    joined = conflicts.join(resolutions.select(F.col("conflict_id").alias("_c"), "resolution"), F.col("conflict_id") == F.col("_c"), "left")
    return joined.withColumn("status", F.when(F.col("status").isin("OPEN", "UNDER_REVIEW") & F.col("resolution").isNotNull(), F.col("resolution")).otherwise(F.col("status"))).drop("_c", "resolution")
