"""Classification, matching and decision queries over candidates derived from the supplied rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as log
from ..operators import review as op
from ..sources.views import table

_KINDS = ("mine", "project", "measurement", "production_record", "coordinate", "table_note")


def _pick(values, at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of six types."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = _pick(_KINDS, k % 6)
    meta = F.map_filter(F.create_map(
        F.lit("table_header"), _pick(("Depth of seam", "Share of total", "Note"), k % 3), F.lit("reporting_period"), F.when(k % 4 != 0, "2020-21").otherwise("n/a"),
        F.lit("longitude"), (k % 200).cast("string"), F.lit("latitude"), F.when(k % 11 != 0, (k % 100).cast("string")),
    ), lambda _, v: v.isNotNull())
    value = F.when(kind.isin("mine", "project"), F.concat(F.initcap("p_name"), F.lit(" "), k % 40)).when(k % 17 == 0, None).otherwise(F.col("p_size").cast("string"))
    failed = F.when(k % 13 == 0, F.array(F.struct(F.lit("scan").alias("rule"), F.lit("FAILED").alias("status")))).otherwise(F.array().cast("array<struct<rule:string,status:string>>"))
    return p.select(
        k.alias("id"), kind.alias("candidate_type"), F.concat(F.lit("text "), "p_name").alias("raw_text"), value.alias("raw_value"), value.alias("normalized_value"),
        F.when(k % 17 != 0, F.col("p_size").cast("decimal(24,9)") - 1).alias("normalized_numeric_value"), _pick(("t", "m", "%", "MT", None), k % 5).alias("unit"), meta.alias("metadata"), failed.alias("validation_results"),
        _pick(("PENDING", "IN_REVIEW", "VERIFIED", "REJECTED"), k % 4).alias("verification_status"), (k % 50).alias("page_id"), (k % 20).alias("document_id"), F.concat("p_brand", F.lit("|"), k % 30).alias("semantic_key"),
    )


_CANDS = """c AS (SELECT p_partkey AS id, ['mine', 'project', 'measurement', 'production_record', 'coordinate', 'table_note'][p_partkey % 6 + 1] AS kind, p_partkey AS k, p_size, p_name, p_brand,
  CASE WHEN p_partkey % 6 < 2 THEN upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' ' || (p_partkey % 40) WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size::VARCHAR END AS v,
  ['t', 'm', '%', 'MT', NULL][p_partkey % 5 + 1] AS unit, p_partkey % 13 = 0 AS failed FROM part)"""
_CLASS = f"""WITH {_CANDS},
k AS (SELECT *, CASE WHEN kind = 'coordinate' AND failed THEN 'coordinate_validation_failed' WHEN v IS NULL THEN 'candidate_value_missing'
  WHEN kind = 'production_record' AND unit = 't' AND k % 4 <> 0 AND NOT failed THEN 'verified_production_fields_present' WHEN kind = 'production_record' THEN 'production_fallback'
  WHEN kind = 'measurement' AND k % 3 = 0 THEN 'measurement_header_label' WHEN kind = 'measurement' AND unit = '%' AND k % 3 = 1 THEN 'percentage_source_semantics' WHEN kind = 'measurement' THEN 'measurement_source_value'
  WHEN kind = 'table_note' THEN 'no_deterministic_rule' ELSE 'candidate_type:' || kind END AS rule FROM c),
r AS (SELECT *, CASE WHEN rule IN ('coordinate_validation_failed', 'candidate_value_missing', 'no_deterministic_rule') THEN 'UNKNOWN' WHEN kind = 'production_record' THEN 'PRODUCTION' WHEN rule = 'measurement_header_label' THEN 'GEOLOGICAL_MEASUREMENT' WHEN kind = 'measurement' THEN 'MEASUREMENT' ELSE upper(kind) END AS classification,
  CASE WHEN rule IN ('coordinate_validation_failed', 'candidate_value_missing', 'no_deterministic_rule') THEN NULL WHEN rule IN ('production_fallback', 'measurement_source_value') THEN 0.85 WHEN kind = 'measurement' THEN 0.92 ELSE 0.97 END::DOUBLE AS confidence FROM k)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.classify(candidates(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("id", "classification", "confidence", "rule")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.refresh_validation(candidates(spark, sf_dir))
    return out.select("id", F.explode("validation_results").alias("v")).select("id", "v.rule", "v.status")


_REFRESHED = f"""WITH {_CANDS} SELECT id, 'scan' AS rule, 'FAILED' AS status FROM c WHERE failed
UNION ALL SELECT id, 'production_nonnegative', CASE WHEN v IS NOT NULL AND p_size >= 1 THEN 'PASSED' ELSE 'FAILED' END FROM c WHERE kind = 'production_record'
UNION ALL SELECT id, 'production_fields', CASE WHEN v IS NOT NULL AND p_size >= 1 AND unit = 't' AND k % 4 <> 0 THEN 'PASSED' ELSE 'FAILED' END FROM c WHERE kind = 'production_record'
UNION ALL SELECT id, 'measurement_value_unit', CASE WHEN k % 17 <> 0 AND unit IN ('t', 'm', '%') THEN 'PASSED' ELSE 'FAILED' END FROM c WHERE kind = 'measurement'
UNION ALL SELECT id, 'coordinate_range', CASE WHEN k % 200 <= 180 AND k % 11 <> 0 AND k % 100 <= 90 THEN 'PASSED' ELSE 'FAILED' END FROM c WHERE kind = 'coordinate'"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.approval_issues(classified(spark, sf_dir)).select("id", F.explode("issues").alias("issue"))


_APPROVALS = f"""{_CLASS} SELECT id, 'AMBIGUOUS_CLASSIFICATION' AS issue FROM r WHERE classification = 'UNKNOWN' UNION ALL SELECT id, 'NO_VALUE' FROM r WHERE v IS NULL AND k % 17 = 0
UNION ALL SELECT id, 'REJECTED' FROM r WHERE k % 4 = 3 UNION ALL SELECT id, 'VALUE_OR_UNIT_MISSING' FROM r WHERE classification IN ('PRODUCTION', 'GEOLOGICAL_MEASUREMENT', 'MEASUREMENT') AND (k % 17 = 0 OR unit IS NULL)
UNION ALL SELECT id, 'FAILED_VALIDATION' FROM r WHERE failed UNION ALL SELECT id, 'COORDINATE_MISSING' FROM r WHERE kind = 'coordinate' AND k % 11 = 0
UNION ALL SELECT id, 'COORDINATE_OUT_OF_RANGE' FROM r WHERE kind = 'coordinate' AND k % 11 <> 0 AND (k % 200 > 180 OR k % 100 > 90)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    edited = F.when(k % 6 == 0, None).when(k % 6 == 1, F.create_map(F.lit("color"), F.lit("red"))).when(k % 6 == 2, F.create_map(F.lit("unit"), F.lit("t"))).when(k % 6 == 3, F.create_map(F.lit("normalized_numeric_value"), F.lit("x"))).when(k % 6 == 4, F.create_map(F.lit("normalized_numeric_value"), F.lit("5"), F.lit("unit"), F.lit("MT"))).otherwise(F.create_map(F.lit("normalized_numeric_value"), F.lit("5"), F.lit("unit"), F.lit("kt")))
    return op.edit_issues(e.select("event_id", F.lit("PRODUCTION").alias("classification"), edited.alias("edited"))).select("event_id", "edit_issue")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known mines: names of parts with a number, one letter missing in some."""
    p = table(spark, sf_dir, "part").where("p_partkey % 6 = 0")
    from ..functions.text import entity_key

    name = F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_partkey") % 40)
    key = entity_key(name)
    e = p.select(F.col("p_partkey").alias("entity_id"), F.lit("MINE").alias("entity_type"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.substring(key, 1, 2), F.substring(key, 4, 100))).otherwise(key).alias("entity_key"))
    return e.where("entity_id % 12 = 0").groupBy("entity_type", "entity_key").agg(F.min("entity_id").alias("entity_id"))


def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each name; compared with a scan of all pairs in the tests."""
    c = classified(spark, sf_dir).where("classification = 'MINE'").select("id", F.lit("MINE").alias("entity_type"), F.regexp_replace(F.lower("raw_value"), "[^a-z0-9]", "").alias("key"))
    return op.fuzzy_match(c, entities(spark, sf_dir)).select("id", "entity_id", F.round("score", 6).alias("score"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    open_ = op.extraction_conflicts(c.where("id % 3 = 0"))
    return op.propose_mapping(c, entities(spark, sf_dir), open_).groupBy("classification", "mapping_status").agg(F.count(F.lit(1)).alias("n"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflict_keys(candidates(spark, sf_dir)).select("candidate_type", "semantic_key", "n_values", "n_candidates")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extraction_conflicts(candidates(spark, sf_dir)).select("candidate_type", "semantic_key", "id", "status")


_CONFLICTS = f"WITH {_CANDS}, g AS (SELECT kind AS candidate_type, p_brand || '|' || (k % 30) AS semantic_key, count(DISTINCT v) AS n_values, count(*) AS n_candidates FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) > 1)"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_id").alias("conflict_id"), _pick(("OPEN", "UNDER_REVIEW", "RESOLVED"), F.col("event_id") % 3).alias("status"))
    r = e.where("event_id % 2 = 0").select(F.col("event_id").alias("conflict_id"), F.lit("ACCEPTED_AS_SOURCE_VARIATION").alias("resolution"))
    return op.resolve_conflicts(c, r)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") * 7 % 300).alias("id"), F.col("event_id").alias("seq"), _pick(log.ACTIONS, (F.col("event_id") * 31 + F.col("user_id")) % 5).alias("action"), F.col("user_id").alias("actor"))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("PENDING").alias("verification_status"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.fold_decisions(starts(spark, sf_dir), decisions(spark, sf_dir)).select("id", "seq", "action", "state", "outcome")


_FOLD = """RECURSIVE d AS (SELECT user_id * 7 % 300 AS id, event_id AS seq, ['CLAIM', 'APPROVE', 'EDIT_AND_APPROVE', 'REJECT', 'MARK_UNRESOLVED'][(event_id * 31 + user_id) % 5 + 1] AS action, row_number() OVER (PARTITION BY user_id * 7 % 300 ORDER BY event_id) AS r FROM events),
s AS (SELECT id, 0::BIGINT AS seq, '' AS action, 0::BIGINT AS r, CASE WHEN id IN (SELECT p_partkey FROM part) THEN 'PENDING' END AS state, '' AS outcome FROM (SELECT DISTINCT id FROM d)
  UNION ALL SELECT id, seq, action, r, CASE outcome WHEN 'APPLIED' THEN CASE WHEN action = 'CLAIM' THEN 'IN_REVIEW' WHEN action LIKE '%APPROVE' THEN 'VERIFIED' WHEN action = 'REJECT' THEN 'REJECTED' ELSE 'UNRESOLVED' END ELSE state END, outcome FROM (
    SELECT d.id, d.seq, d.action, d.r, s.state, CASE WHEN s.state IS NULL THEN 'NOT_FOUND' WHEN d.action = 'CLAIM' THEN CASE WHEN s.state = 'PENDING' THEN 'APPLIED' WHEN s.state IN ('IN_REVIEW', 'VERIFIED') THEN 'NO_OP' ELSE 'ILLEGAL' END
      WHEN d.action LIKE '%APPROVE' THEN CASE WHEN s.state = 'IN_REVIEW' THEN 'APPLIED' WHEN s.state = 'VERIFIED' THEN 'NO_OP' ELSE 'ILLEGAL' END
      WHEN d.action = 'REJECT' THEN CASE WHEN s.state = 'REJECTED' THEN 'NO_OP' WHEN s.state <> 'VERIFIED' THEN 'APPLIED' ELSE 'ILLEGAL' END ELSE CASE WHEN s.state <> 'VERIFIED' THEN 'APPLIED' ELSE 'ILLEGAL' END END AS outcome
    FROM s JOIN d ON d.id = s.id AND d.r = s.r + 1))"""

#: The same with every candidate known.
FOLD_ALL = _FOLD.replace("CASE WHEN id IN (SELECT p_partkey FROM part) THEN 'PENDING' END", "'PENDING'")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.current_state(starts(spark, sf_dir), log.fold_decisions(starts(spark, sf_dir), decisions(spark, sf_dir))).select("id", "verification_status")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.class_counts(classified(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    return op.status_report({"records": o, "mines": table(spark, sf_dir, "supplier").select("s_suppkey")})


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.queue_filter(classified(spark, sf_dir), status="PENDING", classification="MINE", validation="FAILED").select("id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") + 1).alias("page_number"), F.col("text").alias("page_text"), F.concat(F.lit("file-"), "source").alias("document_name"))


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with the content unit of every second, pages, and content units."""
    c = classified(spark, sf_dir).withColumn("content_id", F.when(F.col("id") % 2 == 0, F.col("id") % 70))
    contents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), F.col("text").alias("content_text"))
    return c, _pages(spark, sf_dir), contents


def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.queue_search(*_searched(spark, sf_dir), "12").select("id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.queue_search(*_searched(spark, sf_dir), "RI_G").select("id")


def unconflicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    x = op.extraction_conflicts(c)
    return op.conflict_filter(c, x, present=False).select("id")


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), "n_name")
    proposals = c.where("id % 2 = 0").select("id", F.lit("NEW").alias("proposal"))
    return op.candidate_detail(c, docs, _pages(spark, sf_dir), proposals, op.extraction_conflicts(candidates(spark, sf_dir))).select("id", "n_name", "page_number", "proposal", "n_conflicts")


def _identity(spark: SparkSession, sf_dir: str, near: bool) -> DataFrame:
    """Customers against suppliers as known entities, by code, name, place; with ``near`` some names are merely like known ones."""
    s = table(spark, sf_dir, "supplier")
    e = s.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Mine Alpha "), F.format_string("%04d", "s_suppkey")).alias("canonical_name"), F.array(F.concat(F.lit("A-"), "s_suppkey")).alias("aliases"), F.concat(F.lit("C"), "s_suppkey").alias("domain_code"), F.concat(F.lit("P"), F.col("s_nationkey")).alias("parent"), (F.col("s_suppkey") / 10.0).alias("lat"), (F.col("s_suppkey") / 5.0).alias("lon"))
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    if not near:  # names that are like none where they are none
        c = c.crossJoin(F.broadcast(s.agg(F.max("s_suppkey").alias("n"))))  # one row
    known = F.lit(True) if near else k <= F.col("n")
    name = F.when(k % 6 == 0, F.concat(F.lit("a "), k)).when((k % 6 == 1) & known, F.concat(F.lit("MINE-ALPHA "), F.format_string("%04d", k))).when(k % 6 == 2, "").otherwise(F.concat(F.lit("zz"), k))
    cands = c.select(k.alias("id"), name.alias("name"), F.when(k % 6 == 3, F.concat(F.lit("c"), k)).alias("code"), F.when(k % 12 == 1, "other").alias("parent"), F.when(k % 6 == 4, k / 10.0 + 0.001).alias("lat"), F.when(k % 6 == 4, k / 5.0).alias("lon"))
    return op.resolve_identity(cands, e)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity(spark, sf_dir, False)


def identity_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With names that similarity alone decides; compared with a scan of all pairs in the tests."""
    return _identity(spark, sf_dir, True)


_IDENTITY = """WITH n AS (SELECT max(s_suppkey) AS n FROM supplier) SELECT c_custkey AS id, CASE WHEN k = 2 THEN 'UNRESOLVED' WHEN c_custkey > n OR k = 5 THEN 'NEW' WHEN k = 0 THEN 'MATCHED' WHEN k = 1 THEN CASE WHEN c_custkey % 12 = 1 THEN 'CONFLICT' ELSE 'MATCHED' END ELSE 'POSSIBLE_MATCH' END AS identity_status,
  CASE WHEN k <> 2 AND k <> 5 AND c_custkey <= n THEN c_custkey END AS entity_id FROM (SELECT *, c_custkey % 6 AS k FROM customer), n"""


QUERIES = {
    "k01_classified": (classes, f"{_CLASS} SELECT id, classification, confidence, rule FROM r"),
    "k02_refreshed_validation": (refreshed, _REFRESHED),
    "k03_approval_issues": (approvals, _APPROVALS),
    "k04_edit_issues": (edits, "SELECT event_id, [NULL, 'UNSUPPORTED_FIELDS', 'NO_VALUE', 'NOT_A_NUMBER', 'UNIT_UNKNOWN', NULL][event_id % 6 + 1] AS edit_issue FROM events"),
    "d10_fuzzy_match": (fuzzy, None),
    "k06_mapping": (mapped, None),
    "k07_identity": (identity, _IDENTITY),
    "k07_identity_near": (identity_near, None),
    "k08_class_counts": (counts, f"{_CLASS} SELECT classification, count(*) AS n FROM r GROUP BY 1"),
    "d09_conflict_keys": (conflicts, f"{_CONFLICTS} SELECT * FROM g"),
    "k09_conflict_members": (members, f"{_CONFLICTS} SELECT candidate_type, semantic_key, id, 'OPEN' AS status FROM c JOIN g ON kind = candidate_type AND p_brand || '|' || (k % 30) = semantic_key"),
    "k10_resolved_conflicts": (resolved, "SELECT event_id AS conflict_id, event_id % 2 = 0 AND event_id % 3 < 2 AS changed, CASE WHEN event_id % 2 = 0 AND event_id % 3 < 2 THEN 'ACCEPTED_AS_SOURCE_VARIATION' ELSE ['OPEN', 'UNDER_REVIEW', 'RESOLVED'][event_id % 3 + 1] END AS status FROM events"),
    "k11_status_report": (report, "SELECT 'records' AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'mines', 'TOTAL', count(*) FROM supplier"),
    "l01_decisions": (events, f"WITH {_FOLD} SELECT id, seq, action, state, outcome FROM s WHERE r > 0"),
    "l01_current_state": (state, f"WITH {_FOLD} SELECT p_partkey AS id, coalesce((SELECT arg_max(state, r) FROM s WHERE s.id = p_partkey), 'PENDING') AS verification_status FROM part"),
    "c04_queue_search_digits": (digits, f"WITH {_CANDS} SELECT id FROM c WHERE k % 50 = 11 OR lower(v) = '12'"),
    "c05_queue_search_text": (words, f"{_CLASS} SELECT id FROM r JOIN documents d ON d.doc_id = k % 50 LEFT JOIN documents t ON t.doc_id = CASE WHEN id % 2 = 0 THEN id % 70 END WHERE lower('text ' || p_name) LIKE '%ri_g%' OR lower(v) LIKE '%ri_g%' OR kind LIKE '%ri_g%' OR lower(classification) LIKE '%ri_g%' OR lower('file-' || d.source) LIKE '%ri_g%' OR lower(t.text) LIKE '%ri_g%'"),
    "c06_queue_filter": (queue, f"{_CLASS} SELECT id FROM r WHERE k % 4 = 0 AND classification = 'MINE' AND failed"),
    "c08_without_conflict": (unconflicted, f"{_CONFLICTS} SELECT id FROM c WHERE (kind, p_brand || '|' || (k % 30)) NOT IN (SELECT (candidate_type, semantic_key) FROM g)"),
    "d13_candidate_detail": (detail, f"{_CONFLICTS} SELECT id, n_name, k % 50 + 1 AS page_number, CASE WHEN id % 2 = 0 THEN 'NEW' END AS proposal, CASE WHEN g.semantic_key IS NULL THEN 0 ELSE 1 END AS n_conflicts FROM c LEFT JOIN nation ON n_nationkey = k % 20 LEFT JOIN g ON kind = candidate_type AND p_brand || '|' || (k % 30) = semantic_key"),
}
