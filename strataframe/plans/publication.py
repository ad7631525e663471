"""Publication, event, quality, report and streaming queries over the supplied rows, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as op
from ..operators import events as log
from ..operators import quality, reports
from ..operators import spatial as geo
from ..operators.decisions import ACTIONS
from ..operators.paging import keep_pages, list_by_status, read_page
from ..operators.production import production_report
from ..sources.views import table
from ..streaming import index, jobs, uploads
from ..streaming.tables import folder, source
from . import production, review, spatial, text


def _pick(values, at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))




def _approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an approval, every fifth edited."""
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw_value"), F.col("p_name").alias("normalized_value"), F.lit("t").alias("unit"))
    a = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("verified_by"), F.col("p_partkey").alias("verified_seq"), F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("normalized_value"), F.lit("edited"))).alias("edited"))
    return op.canonical_records(c, a)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir).select("id", F.col("original.raw_value").alias("original"), "accepted_value", "edited_flag", "verified_by")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type"), F.initcap("p_name").alias("name"))
    known = table(spark, sf_dir, "part").where("p_partkey < 20").select(F.col("p_type").alias("entity_type"), F.regexp_replace("p_name", " ", "").alias("entity_key")).distinct()
    return op.upsert_entities(p, known).select("entity_type", "entity_key", "created_by")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "VERIFIED").otherwise("PENDING").alias("verification_status"), _pick(("MINE", "UNKNOWN", "PRODUCTION", "MEASUREMENT"), F.col("p_partkey") % 8 / 2).alias("classification"), _pick(("APPROVED", "NEW", "CONFLICT"), F.col("p_partkey") % 3).alias("mapping_status"), F.lit(1).alias("verified_by"), F.when(F.col("p_partkey") % 10 == 0, 2).otherwise(1).alias("actor"), F.when(F.col("p_partkey") % 14 != 0, "VERIFIER").alias("role"))
    return op.publish_gate(p).select("id", "reason")


_GATE = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 <> 0 THEN 'NOT_VERIFIED' WHEN (p_partkey % 8) // 2 = 1 OR p_partkey % 3 = 2 THEN 'NEEDS_HUMAN_RESOLUTION' WHEN p_partkey % 14 = 0 THEN 'ROLE_REQUIRED' WHEN p_partkey % 10 = 0 THEN 'OTHER_VERIFIER'
  WHEN p_partkey % 3 <> 0 THEN 'MAPPING_NOT_APPROVED' WHEN (p_partkey % 8) // 2 = 3 THEN 'NO_DOMAIN_MAPPING' END AS reason FROM part"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known suppliers and the names that customers give them."""
    s = table(spark, sf_dir, "supplier")
    none = lambda t: F.lit(None).cast(t)
    known = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.array(F.concat(F.lit("old "), "s_suppkey")).alias("aliases"), F.concat(F.lit("C"), "s_suppkey").alias("domain_code"), none("string").alias("parent"), none("double").alias("lat"), none("double").alias("lon"))
    c = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("OLD-"), "s_suppkey").alias("name"), none("string").alias("code"), none("string").alias("parent"), none("double").alias("lat"), none("double").alias("lon")).where("id % 2 = 0")
    return op.publish_entities(c, known)[1].select("entity_id", F.sort_array("aliases").alias("aliases"))


def bad_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 40).alias("n"))
    return op.check_refs(c, table(spark, sf_dir, "nation"), "n", "n_nationkey").select("c_custkey")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("value"), F.when(F.col("p_partkey") % 5 != 0, "t").alias("unit"), F.when(F.col("p_partkey") % 7 != 0, "2020").alias("period"))
    p = p.withColumns({"borehole_id": F.when(F.col("id") % 11 == 0, F.col("id")), "mine_id": F.when(F.col("id") % 2 == 0, F.col("id") % 40)})
    boreholes = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("borehole_id"))
    mines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("mine_id"))
    m, q = op.publish_measurements(p, borehole_id=boreholes), op.publish_production(p, mine_id=mines)
    return m.select("id", F.lit("measurement").alias("kind"), "reason").unionByName(q.select("id", F.lit("production").alias("kind"), "reason"))


_FACTS = """WITH m AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'value' END, CASE WHEN p_partkey % 5 = 0 THEN 'unit' END], lambda x: x IS NOT NULL) AS a, CASE WHEN p_partkey % 7 = 0 THEN ['period'] ELSE [] END AS b FROM part)
SELECT id, 'measurement' AS kind, CASE WHEN len(a) > 0 THEN 'MISSING ' || array_to_string(a, ',') WHEN id % 11 = 0 AND id % 2 = 1 THEN 'UNKNOWN borehole_id' END AS reason FROM m
UNION ALL SELECT id, 'production', CASE WHEN len(a) + len(b) > 0 THEN 'MISSING ' || array_to_string(list_concat(a, b), ',') WHEN id % 2 = 0 AND id % 40 NOT IN (SELECT n_nationkey FROM nation) THEN 'UNKNOWN mine_id' END FROM m"""


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).cast("string").alias("lat"), (F.col("p_partkey") % 170).cast("string").alias("lon"), _pick(("epsg:4326", "4326", "EPSG:3857", "", "WGS-84", None), F.col("p_partkey") % 6).alias("crs"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("20.5, "), F.col("p_partkey") % 80, F.lit(".25"))).alias("accepted"), F.when(F.col("p_partkey") % 4 != 0, "VERIFIED").otherwise("PENDING").alias("verification_status"), F.lit("COORDINATE").alias("classification"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.publish_coordinates(_coordinates(spark, sf_dir), "accepted").select("id", "reason", F.col("point.geometry_wkt").alias("wkt"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coordinates(spark, sf_dir)
    return op.missing_trusted(c, c.where("id % 5 = 0").select(F.col("id").alias("source_candidate_id"))).select("id")


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coordinates(spark, sf_dir)
    return op.backfill_coordinates(c, c.where("id % 5 = 0").select(F.col("id").alias("source_candidate_id")))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("MINE").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("string").alias("value"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.value_history(_values(spark, sf_dir)).select("entity_id", "field", "seq", "value")


def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.value_conflicts(_values(spark, sf_dir)).select("entity_id", "field", "seq", "value_a", "value_b")


_VALUES = "WITH v AS (SELECT user_id AS entity_id, event_type AS field, event_id AS seq, (event_id % 3)::VARCHAR AS value, first_value((event_id % 3)::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS f FROM events)"


def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coordinates(spark, sf_dir).withColumn("classification", F.when(F.col("id") % 2 == 0, "COORDINATE").otherwise("MINE"))
    ids = c.select(F.col("id").alias("source_candidate_id"))
    return op.already_published(c, [ids.where("source_candidate_id % 5 = 0"), ids.where("source_candidate_id % 7 = 0")], ids.where("source_candidate_id % 3 = 0")).select("id", "published")


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("verification_id"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("verification_id"), (F.col("p_partkey") % 30).alias("document_id"), (F.col("p_partkey") % 60).alias("page_id"))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), "n_name")
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang")
    return op.field_provenance(h, r, d, p).select("event_id", "n_name", "lang")


def data_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = op.value_conflicts(_values(spark, sf_dir)).select(F.col("seq").alias("conflict_id"), F.when(F.col("seq") % 5 == 0, "RESOLVED").otherwise("OPEN").alias("status"))
    return op.resolve_data_conflicts(c, c.where("conflict_id % 2 = 0").select("conflict_id", F.lit("DISMISSED").alias("resolution")))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("details"))
    r = e.where("event_id % 4 = 0").select("event_id", "ts", F.col("user_id").alias("actor"), F.lit("CLAIM").alias("action"), F.col("event_id").alias("candidate_id"), F.lit("PENDING").alias("previous_state"), F.lit("IN_REVIEW").alias("new_state"))
    return log.audit_events(a, r)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("source", "event_id", "action", "detail")


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down the audit events, and the first and last ones, of rows sorted once."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 1).alias("value"))
    path = keep_pages(e, ("value", "event_id"), "value", "event_id", descending=True)
    last = read_page(e, path, 1, 5).select("pages").first()
    out = [read_page(e, path, page, 5) for page in (1, 150, last["pages"] if last else 2)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_by_status(_log(spark, sf_dir), None, "ts", "source", 200).select("source", "event_id")


def trusted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.union_all({"MINE": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "PRODUCTION": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value")), "BOREHOLE": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))})


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 13) / 10.0).alias("confidence"), (F.col("p_size") - 2).alias("row_index"), (F.col("p_partkey") % 4).alias("version"), _pick(("OPEN", "CLOSED", "LOST"), F.col("p_partkey") % 3).alias("status"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("mine_id"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).alias("project_id"), (F.col("p_partkey") % 20).alias("period_start"), (F.col("p_partkey") % 21).alias("period_end"), (F.col("p_partkey") % 9 - 1).alias("top"), (F.col("p_partkey") % 11).alias("bottom"), F.col("p_size").alias("depth"), F.when(F.col("p_partkey") % 50 == 0, float("nan")).otherwise(1.0).alias("value"))
    rules = [quality.confidence(), quality.nonnegative("row_index"), quality.positive("version"), quality.one_of("status", ("OPEN", "CLOSED")), *quality.production(), *quality.geology()]
    unique = quality.duplicates(table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])
    return quality.quality_report([quality.violations(p, "part", "id", rules), unique]).select("table", "rule", "key", "severity")


_RULES = {
    "confidence_range": "p_partkey % 13 > 10", "row_index_nonnegative": "p_size < 2", "version_positive": "p_partkey % 4 = 0", "status_known": "p_partkey % 3 = 2", "entity_required": "p_partkey % 3 = 0 AND p_partkey % 5 <> 0",
    "period_order": "p_partkey % 21 < p_partkey % 20", "top_nonnegative": "p_partkey % 9 = 0", "interval_order": "p_partkey % 11 < p_partkey % 9 - 1", "depth_nonnegative": "p_size < 0", "value_finite": "p_partkey % 50 = 0",
}
_CHECKED = " UNION ALL ".join(f"SELECT 'part' AS \"table\", '{r}' AS rule, p_partkey::VARCHAR AS key, 'ERROR' AS severity FROM part WHERE {w}" for r, w in _RULES.items()) + " UNION ALL SELECT 'lineitem', 'unique_l_orderkey_l_linenumber', l_orderkey || '|' || l_linenumber, 'ERROR' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 60).alias("report_id"), F.concat(F.lit("E"), F.when(F.col("event_id") == 77, 1).otherwise(F.col("event_id"))).alias("citation_id"), F.when(F.col("event_id") % 997 != 5, F.col("event_id") % 20).alias("document_id"), (F.col("event_id") % 40).alias("document_version_id"), F.col("event_id").alias("chunk_id"), (F.col("event_id") % 25).alias("page_number"), F.when(F.col("event_id") % 3 == 0, "TRUSTED_CANONICAL_DATA").otherwise("SOURCE_DOCUMENT").alias("evidence_type"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("topic"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    r = e.select("report_id").distinct().withColumn("required", F.array(F.lit("Summary"), F.lit("Findings")))
    title = F.when(F.col("chunk_id") % 2 == 0, "Summary").otherwise("Findings")
    s = e.where("NOT (report_id % 9 = 0 AND chunk_id % 2 = 0)").select("report_id", title.alias("title"), F.when(F.col("report_id") % 7 == 0, "INSUFFICIENT_EVIDENCE").otherwise("COMPLETED").alias("status"), F.when(F.col("report_id") % 14 == 0, "value 5").otherwise("none").alias("text"), F.lit(0).alias("n_items"), F.array(F.when(F.col("chunk_id") == 500, "E999999").otherwise(F.col("citation_id"))).alias("citations"))
    return reports.validate_reports(r, s, e).select("report_id", "status", "problems")


_VALIDATED = """WITH e AS (SELECT user_id % 60 AS r, event_id AS c FROM events), ids AS (SELECT DISTINCT r FROM e),
p AS (SELECT r, 'MISSING_SECTION' AS problem FROM ids WHERE r % 9 = 0 OR r NOT IN (SELECT r FROM e WHERE c % 2 = 0) OR r NOT IN (SELECT r FROM e WHERE c % 2 = 1)
  UNION SELECT r, 'CITATION_NOT_UNIQUE' FROM e WHERE c = 77 AND r IN (SELECT r FROM e WHERE c = 1) UNION SELECT r, 'CITATION_UNKNOWN' FROM e WHERE c = 500 AND r % 9 <> 0
  UNION SELECT r, 'EVIDENCE_WITHOUT_PROVENANCE' FROM e WHERE c % 997 = 5 UNION SELECT r, 'VALUE_IN_INSUFFICIENT_SECTION' FROM e WHERE r % 14 = 0 AND NOT (r % 9 = 0 AND c % 2 = 0))
SELECT r AS report_id, CASE WHEN r IN (SELECT r FROM p) THEN 'VALIDATION_FAILED' WHEN r % 7 = 0 THEN 'INSUFFICIENT_DATA' ELSE 'COMPLETED' END AS status, coalesce((SELECT list(problem ORDER BY problem) FROM p WHERE p.r = ids.r), []) AS problems FROM ids"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.document_report(text.chunks(spark, sf_dir))
    return out.select("section", "term", "frequency", F.size("citations").alias("n_citations"))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison_report(text.chunks(spark, sf_dir)).select("class", "n_topics", "first_topics")


def executive(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spatial.layers(spark, sf_dir)
    return reports.executive_report(production_report(production.verified(spark, sf_dir)), geo.count_layers(layers), layers).withColumn("value", F.round("value", 3))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_sources(_evidence(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reference_summary(_evidence(spark, sf_dir).where("document_id IS NOT NULL"))


_SUMMARY = """WITH e AS (SELECT user_id % 60 AS report_id, event_id % 20 AS document_id, event_id % 25 AS page, event_id FROM events WHERE event_id % 997 <> 5),
p AS (SELECT report_id, document_id, list_sort(list_distinct(list(page))) AS ps, count(*) FILTER (WHERE event_id % 3 = 0) AS n_trusted FROM e GROUP BY 1, 2)
SELECT report_id, document_id, array_to_string(ps[1:8], ', ') || CASE WHEN len(ps) > 8 THEN ' +' || (len(ps) - 8) || ' more' ELSE '' END AS pages, n_trusted FROM p"""


def numeric_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    items = e.select((F.col("user_id") % 60).alias("report_id"), F.col("event_id").alias("item_index"), F.create_map(F.lit("count"), (F.col("event_id") % 10).cast("string"), F.lit("kind"), F.col("event_type")).alias("fields"), F.array(F.lit("E1")).alias("citations"))
    return reports.findings(items).select("report_id", "rank", "value", F.get_json_object("dimensions", "$.kind").alias("kind"))


def appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.appendix_evidence(_evidence(spark, sf_dir)).select("report_id", "position", "rank")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).where("topic IS NOT NULL")
    ev = e.groupBy(F.col("topic").alias("term")).agg(F.sort_array(F.collect_list(F.struct(F.col("report_id").alias("document_id"), "chunk_id"))).alias("evidence"))
    return reports.cite(ev, e.where("chunk_id % 3 <> 0").select("chunk_id", "citation_id"))


def _drained(spark: SparkSession, out: DataFrame, mode: str = "append", at: str | None = None, back: SparkSession | None = None) -> DataFrame:
    """What a stream writes when it has read all its input, as a table of the session ``back``."""
    at = at or folder(spark)
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/rows").awaitTermination()
    return (back or spark).read.schema(out.schema).parquet(f"{at}/rows")


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files in four uploads, days apart: each a batch of one stream."""
    at = folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("|", "user_id", "event_type").alias("content"))
    n = e.agg(F.max("event_id").alias("n")).first()["n"] or 0
    for k in range(4):
        e.where((F.col("event_id") * 4 > n * k - (k == 0)) & (F.col("event_id") * 4 <= n * (k + 1))).write.mode("append").parquet(f"{at}/in")
        uploads.stream_uploads(spark.readStream.schema(e.schema).parquet(f"{at}/in"), at, f"{at}/state", key="event_id").awaitTermination()
    return uploads.uploads(spark, at, "event_id")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir).where("NOT duplicate").select("checksum")


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir).where("duplicate").select("event_id", "surviving_id")


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed when the stream ends."""
    return _drained(spark, jobs.stream_activity(source(spark, sf_dir, "events"))).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "action", "n")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in sixteen files, every two of them in the wrong order; a last one, long after, lets the watermark pass them all."""
    at, session = folder(spark), spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    # each batch starts a worker and opens a store for every part of the state, so there are no more parts than cores ask for
    session.conf.set("spark.sql.shuffle.partitions", min(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    d = table(spark, sf_dir, "events").select((F.col("user_id") * 7 % 300).alias("id"), F.col("event_id").alias("seq"), _pick(ACTIONS, (F.col("event_id") * 31 + F.col("user_id")) % 5).alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    n, newest, oldest = d.agg(F.max("seq"), F.max("ts"), F.min("ts")).first()
    d.withColumn("k", F.floor(F.col("seq") * 16 / (n + 1))).write.partitionBy("k").parquet(f"{at}/dealt")  # the table is read once
    dealt = spark.read.parquet(f"{at}/dealt")
    spans = {r["k"]: r for r in dealt.groupBy("k").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}  # a row for each file
    late, seen = (newest - oldest) // 4, oldest
    for k in range(16):  # no file is later than the watermark allows, however its times lie
        if r := spans.get(k ^ 1):
            late, seen = max(late, seen - r["first"] + timedelta(seconds=1)), max(seen, r["last"])
    for k in range(16):
        dealt.where(F.col("k") == (k ^ 1)).drop("k").coalesce(1).write.mode("append").parquet(f"{at}/in")
    spark.createDataFrame([(-1, n + 1, ACTIONS[0], newest + late + timedelta(days=90))], d.schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    out = jobs.stream_decisions(session.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), late=f"{late // timedelta(seconds=1)} seconds")
    return _drained(session, out, at=at, back=spark)


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, vectors for some, then some documents again, every second of these with another text, and new ones."""
    at = folder(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk"))
    again = d.where("chunk_id % 3 = 0").withColumn("chunk", F.when(F.col("chunk_id") % 2 == 0, F.lit("another text")).otherwise(F.col("chunk")))
    hashed = d.select(F.col("chunk_id").alias("id"), F.sha2("chunk", 256).alias("text_hash"))  # texts are not moved to meet their vectors
    vectors = hashed.join(table(spark, sf_dir, "embeddings"), F.col("id") == F.col("vec_id")).select("id", "text_hash", F.col("embedding").alias("vector"))
    for k, part in enumerate((d.where("chunk_id % 7 <> 0"), again)):
        part.write.mode("append").parquet(f"{at}/in")
        jobs.stream_index(spark.readStream.schema(d.schema).parquet(f"{at}/in"), f"{at}/index", f"{at}/state", "m1", 64, buckets=64).awaitTermination()
        if k == 0:
            index.attach(spark, f"{at}/index", vectors, "m1", 64, "vectors", buckets=64)
    index.drop_versions(spark, f"{at}/index")
    return index.read_index(spark, f"{at}/index").select("chunk_id", "change", "is_indexed")


QUERIES = {
    "l02_canonical_records": (records, "SELECT p_partkey AS id, p_name AS original, CASE WHEN p_partkey % 5 = 0 THEN 'edited' ELSE p_name END AS accepted_value, p_partkey % 5 = 0 AS edited_flag, p_partkey % 7 AS verified_by FROM part WHERE p_partkey % 3 = 0"),
    "l03_upserted_entities": (upserted, "WITH k AS (SELECT p_type AS entity_type, replace(p_name, ' ', '') AS entity_key, p_partkey FROM part) SELECT entity_type, entity_key, min(p_partkey) AS created_by FROM k WHERE (entity_type, entity_key) NOT IN (SELECT (entity_type, entity_key) FROM k WHERE p_partkey < 20) GROUP BY 1, 2"),
    "l04_publish_gate": (gate, _GATE),
    "l05_published_aliases": (published, "SELECT s_suppkey AS entity_id, list_sort(CASE WHEN s_suppkey % 2 = 0 THEN ['OLD-' || s_suppkey, 'old ' || s_suppkey] ELSE ['old ' || s_suppkey] END) AS aliases FROM supplier"),
    "d11_bad_references": (bad_refs, "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)"),
    "l06_l07_facts": (facts, _FACTS),
    "l08_coordinates": (coordinates, "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 IN (2, 4) THEN 'CRS_UNSUPPORTED' WHEN p_partkey % 10 <> 0 AND p_partkey % 100 > 90 THEN 'INVALID_POINT' END AS reason, CASE WHEN p_partkey % 10 = 0 THEN 'SRID=4326;POINT(20.5 ' || (p_partkey % 80) || '.25)' WHEN p_partkey % 100 <= 90 THEN 'SRID=4326;POINT(' || (p_partkey % 170) || ' ' || (p_partkey % 100) || ')' END AS wkt FROM part"),
    "d08_missing_trusted": (missing, "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0"),
    "l12_backfill": (backfilled, "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'SKIPPED' WHEN p_partkey % 6 IN (2, 4) OR p_partkey % 100 > 90 THEN 'FAILED' ELSE 'CREATED' END AS outcome, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1"),
    "l09_value_history": (history, f"{_VALUES} SELECT entity_id, field, seq, value FROM v WHERE value = f"),
    "l10_value_conflicts": (value_conflicts, f"{_VALUES} SELECT entity_id, field, seq, f AS value_a, value AS value_b FROM v WHERE value <> f"),
    "l11_already_published": (idempotent, "SELECT p_partkey AS id, p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 1) AS published FROM part"),
    "d14_field_provenance": (traced, "SELECT event_id, n_name, lang FROM events JOIN part ON p_partkey = event_id % 500 LEFT JOIN nation ON n_nationkey = p_partkey % 30 LEFT JOIN documents ON doc_id = p_partkey % 60"),
    "l14_data_conflicts": (data_conflicts, f"{_VALUES} SELECT seq AS conflict_id, CASE WHEN seq % 5 = 0 THEN 'RESOLVED' WHEN seq % 2 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM v WHERE value <> f"),
    "m01_audit_events": (audit, """SELECT 'AUDIT' AS source, event_id, event_type AS action, props AS detail FROM events UNION ALL SELECT 'VERIFICATION', event_id, 'CLAIM', '{"candidate_id":' || event_id || ',"previous_state":"PENDING","new_state":"IN_REVIEW"}' FROM events WHERE event_id % 4 = 0"""),
    "c09_deep_page": (deep_page, "SELECT * FROM (SELECT event_id, event_type, round(value, 1) AS value, row_number() OVER (ORDER BY round(value, 1) DESC NULLS LAST, event_id) - 1 AS position, count(*) OVER () AS total, ceil(count(*) OVER () / 5)::BIGINT AS pages FROM events) WHERE position < 5 OR position BETWEEN 745 AND 749 OR position >= 5 * (pages - 1)"),
    "c18_listing": (listing, "SELECT source, event_id FROM (SELECT 'AUDIT' AS source, event_id, ts FROM events UNION ALL SELECT 'VERIFICATION', event_id, ts FROM events WHERE event_id % 4 = 0) ORDER BY ts DESC, source LIMIT 200"),
    "m02_trusted_union": (trusted_union, "SELECT s_suppkey AS id, s_name AS name, NULL::INTEGER AS value, 'MINE' AS entity_type FROM supplier UNION ALL SELECT p_partkey, NULL, p_size, 'PRODUCTION' FROM part UNION ALL SELECT c_custkey, c_name, NULL, 'BOREHOLE' FROM customer"),
    "v07_quality_report": (checked, _CHECKED),
    "n01_validated_reports": (validated, _VALIDATED),
    "n02_document_report": (sections, text._sql(", k AS (SELECT 'keywords' AS section, term, count(*) AS frequency FROM counted GROUP BY term ORDER BY frequency DESC, term LIMIT 20), t AS (SELECT 'topics' AS section, term, count(*) AS frequency FROM counted WHERE contains(term, ' ') GROUP BY term ORDER BY frequency DESC, term LIMIT 20) SELECT section, term, frequency, least(frequency, 5)::INTEGER AS n_citations FROM (SELECT * FROM k UNION ALL SELECT * FROM t)")),
    "n03_comparison_report": (comparison, text._sql(f", {text._OWN}, r AS (SELECT term, sum(frequency) AS total, CASE WHEN count(*) = (SELECT count(DISTINCT source) FROM documents) THEN 'COMMON' ELSE 'DOCUMENT_SPECIFIC' END AS class FROM own GROUP BY 1), z AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY total DESC, term) AS r FROM r) SELECT class, count(*) AS n_topics, list(term ORDER BY r) FILTER (WHERE r <= 5) AS first_topics FROM z GROUP BY 1")),
    "n04_executive_report": (executive, "SELECT section, key, value FROM (" + production.QUERIES["i25_production_report"][1] + ") UNION ALL SELECT section, key, value FROM (" + spatial._LAYERS + "SELECT 'layers' AS section, entity_type AS key, count(*)::DOUBLE AS value FROM layers GROUP BY 2 UNION ALL SELECT 'features', entity_type, count(*)::DOUBLE FROM (SELECT * FROM layers ORDER BY entity_type, id LIMIT 100) GROUP BY 2" + ")"),
    "n05_report_sources": (sources, "SELECT user_id % 60 AS report_id, list_sort(list(DISTINCT event_id % 20) FILTER (WHERE event_id % 997 <> 5)) AS document_ids, list_sort(list(DISTINCT event_id % 40)) AS version_ids FROM events GROUP BY 1"),
    "n06_reference_summary": (summary, _SUMMARY),
    "n07_findings": (numeric_findings, "SELECT report_id, r AS rank, v AS value, event_type AS kind FROM (SELECT user_id % 60 AS report_id, (event_id % 10)::VARCHAR AS v, event_type, row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS r FROM events) WHERE r <= 4"),
    "n08_appendix_evidence": (appendix, "SELECT report_id, position, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY tier, position) AS r FROM (SELECT user_id % 60 AS report_id, event_id AS position, CASE WHEN event_id % 2 = 0 AND row_number() OVER (PARTITION BY user_id % 60, CASE WHEN event_id % 2 = 0 THEN event_type END ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS tier FROM events)) WHERE r <= 10"),
    "d15_citations": (cited, "SELECT event_type AS term, list('E' || CASE WHEN event_id = 77 THEN 1 ELSE event_id END ORDER BY user_id % 60, event_id) AS citations FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 GROUP BY 1"),
    "s01_stream_dedup": (stream_unique, "SELECT DISTINCT sha256(user_id || '|' || event_type) AS checksum FROM events"),
    "s01_stream_rejected": (stream_rejected, "SELECT event_id, f AS surviving_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) WHERE event_id <> f"),
    "s02_stream_index": (stream_index, "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN 'ADDED' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'CHANGED' ELSE 'KEPT' END AS change, doc_id % 7 <> 0 AND doc_id % 6 <> 0 AND text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings) AS is_indexed FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 3 = 0"),
    "s03_stream_activity": (stream_activity, "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, action, n FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"),
    "s04_stream_decisions": (stream_states, f"WITH {review.FOLD_ALL} SELECT id, seq, action, state, outcome FROM s WHERE r > 0"),
}
