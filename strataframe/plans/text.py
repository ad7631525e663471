"""Keyword, topic and chunk queries over the supplied documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import intel
from ..sources.views import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: one chunk each, in documents by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_id"), F.col("doc_id").alias("chunk_id"), "text")


_STOPS = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
_TERMS = f"""
every AS (SELECT source AS document_id, doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9-]+') AS t FROM documents),
flat AS (SELECT document_id, chunk_id, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM every),
fine AS (SELECT *, NOT (a IN ({_STOPS}) OR regexp_full_match(a, '[a-z]{{1,2}}|[0-9]+|[a-f0-9]{{12,}}')) AS ga, coalesce(NOT (b IN ({_STOPS}) OR regexp_full_match(b, '[a-z]{{1,2}}|[0-9]+|[a-f0-9]{{12,}}')), false) AS gb FROM flat),
counted AS (SELECT document_id, chunk_id, term, count(*) AS n FROM (SELECT document_id, chunk_id, a AS term FROM fine WHERE ga UNION ALL SELECT document_id, chunk_id, a || ' ' || b FROM fine WHERE ga AND gb AND a <> b) GROUP BY 1, 2, 3)
"""


def _sql(tail: str) -> str:
    return f"WITH {_TERMS}{tail}"


def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.chunk_terms(chunks(spark, sf_dir)).select("document_id", "chunk_id", "term", "n")


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.keywords(chunks(spark, sf_dir)).select("term", "frequency", "token_frequency", "document_count", "page_count", "weight")


def keywords_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.keywords(chunks(spark, sf_dir), 20, ("document_id",), page_counts=False).select("document_id", "term", "frequency", "token_frequency", "weight")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    out = intel.evidence(c, intel.first_terms(c))
    return out.select("term", F.transform("evidence", lambda x: x["chunk_id"]).alias("chunk_ids"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.topics(chunks(spark, sf_dir))


_TOPICS = "top AS (SELECT term, count(*) AS frequency, count(DISTINCT document_id) AS document_count FROM counted WHERE contains(term, ' ') GROUP BY 1 ORDER BY frequency DESC, term LIMIT 100)"


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return intel.distribution(c, intel.first_terms(c, pairs_only=True))


def document_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return intel.topics_for_document(intel.distribution(c, intel.first_terms(c, pairs_only=True)), "src1")


_OWN = "own AS (SELECT * FROM (SELECT document_id, term, count(*) AS frequency, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, term) AS r FROM counted WHERE contains(term, ' ') GROUP BY 1, 2) WHERE r <= 100)"


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.compare_documents(chunks(spark, sf_dir))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and one alone."""
    c = chunks(spark, sf_dir)
    return intel.comparison_status(c).unionByName(intel.comparison_status(c.where("document_id = 'src1'")))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.frequency_changes(chunks(spark, sf_dir))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.topic_sets(chunks(spark, sf_dir), "src1", "src2")


def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    runs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("document_id")).agg(F.count(F.when(F.col("doc_id") % 17 != 0, 1)).alias("chunk_count")).where(F.col("document_id") != "src3")
    return intel.needs_rebuild(runs, c)


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names stand for topic labels."""
    p = table(spark, sf_dir, "part")
    words = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("raw coal", "coal resource", "production", "closing stock", "price list", "captive mine", "world coal", "other"))), F.col("p_size") % 8 + 1), "p_name")
    return intel.themes(p.groupBy(words.alias("term")).agg(F.count(F.lit(1)).alias("frequency"))).select("theme", "term", "frequency", "rank")


_THEMES = """WITH t AS (SELECT ['raw coal', 'coal resource', 'production', 'closing stock', 'price list', 'captive mine', 'world coal', 'other'][p_size % 8 + 1] || ' ' || p_name AS term, count(*) AS frequency FROM part GROUP BY 1),
h AS (SELECT *, CASE """ + " ".join(f"WHEN regexp_matches(lower(term), '{w}') THEN '{n}'" for n, w in intel.THEMES) + """ END AS theme FROM t)
SELECT theme, term, frequency, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY frequency DESC, term) AS r FROM h WHERE theme IS NOT NULL) WHERE r <= 5"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    return d.select("doc_id", fn.entity_key(F.col("name")).alias("entity_key"), fn.name_key(F.col("name")).alias("name_key"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fn.uuid5(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), F.concat(F.lit("doc:"), F.col("doc_id"))).alias("id"))


_UUID = """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents)"""


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", fn.safe_filename(F.col("url")).alias("name"))


_FILENAMES = r"""WITH l AS (SELECT page_id, regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1) AS leaf FROM pages),
c AS (SELECT page_id, lower(regexp_extract(leaf, '^.+(\.[^.]+)$', 1)) AS extension, regexp_replace(regexp_replace(regexp_replace(strip_accents(leaf), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS clean FROM l),
s AS (SELECT page_id, extension, substr(regexp_replace(regexp_replace(clean, '\.[^.]+$', ''), '^[._-]+|[._-]+$', '', 'g'), 1, 160) AS stem FROM c)
SELECT page_id, CASE WHEN stem = '' THEN 'document' ELSE stem END || extension AS name FROM s"""


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("user "), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, F.lit(" verification_id 6ba7b811-9dad-11d1-80b4-00c04fd430c8")).otherwise(F.lit(" ok")))
    return e.select("event_id", fn.redact(text).alias("shown"), fn.safe_narrative(text).alias("narrative"))


_REDACTED = "SELECT event_id, 'user ' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ok' END AS shown, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user ' || user_id || ' ok' END AS narrative FROM events"

QUERIES = {
    "h01_chunk_terms": (chunk_terms, _sql("SELECT * FROM counted")),
    "h03_keywords": (keywords, _sql(", k AS (SELECT term, count(*) AS frequency, sum(n)::BIGINT AS token_frequency, count(DISTINCT document_id) AS document_count, count(DISTINCT chunk_id) AS page_count FROM counted GROUP BY 1) SELECT *, round(frequency / (SELECT max(frequency) FROM k), 6) AS weight FROM k ORDER BY frequency DESC, term LIMIT 100")),
    "h04_evidence": (evidence, _sql(", k AS (SELECT term FROM (SELECT term, count(*) AS f FROM counted GROUP BY 1 ORDER BY f DESC, term LIMIT 100)) SELECT term, list(chunk_id ORDER BY r) AS chunk_ids FROM (SELECT term, chunk_id, row_number() OVER (PARTITION BY term ORDER BY document_id, chunk_id) AS r FROM counted WHERE term IN (SELECT term FROM k)) WHERE r <= 5 GROUP BY 1")),
    "h05_topics": (topics, _sql(f", {_TOPICS} SELECT *, round(least(1.0, document_count / (SELECT count(DISTINCT source) FROM documents)), 6) AS confidence FROM top")),
    "h05_distribution": (distribution, _sql(f", {_TOPICS} SELECT term, document_id, count(*) AS frequency FROM counted WHERE term IN (SELECT term FROM top) GROUP BY 1, 2")),
    "c17_topics_for_document": (document_topics, _sql(f", {_TOPICS} SELECT term, count(*) AS frequency FROM counted WHERE term IN (SELECT term FROM top) AND document_id = 'src1' GROUP BY 1")),
    "h07_keywords_by_document": (keywords_by_document, _sql(", k AS (SELECT document_id, term, count(*) AS frequency, sum(n)::BIGINT AS token_frequency, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, term) AS r FROM counted GROUP BY 1, 2) SELECT document_id, term, frequency, token_frequency, round(frequency / max(frequency) OVER (PARTITION BY document_id), 6) AS weight FROM k WHERE r <= 20")),
    "h08_comparison_status": (comparison, "SELECT CASE WHEN n < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPLETED' END AS status, CASE WHEN n > 1 THEN 'INSUFFICIENT_VERIFIED_DATA' END AS numerical_analysis_status, n AS n_documents FROM (SELECT count(DISTINCT source) AS n FROM documents UNION ALL SELECT count(DISTINCT source) FROM documents WHERE source = 'src1')"),
    "h08_frequency_changes": (changes, _sql(f", {_OWN}, every_document AS (SELECT DISTINCT source AS document_id FROM documents) SELECT t.term, d.document_id, coalesce(frequency, 0) AS frequency FROM (SELECT DISTINCT term FROM own) t CROSS JOIN every_document d LEFT JOIN own o ON o.term = t.term AND o.document_id = d.document_id")),
    "h09_compare_documents": (compared, _sql(f", {_OWN} SELECT term, count(*) AS n_documents, sum(frequency)::BIGINT AS total, CASE WHEN count(*) = (SELECT count(DISTINCT source) FROM documents) THEN 'COMMON' ELSE 'DOCUMENT_SPECIFIC' END AS class FROM own GROUP BY 1")),
    "h10_needs_rebuild": (rebuild, "WITH n AS (SELECT source AS document_id, count(*) AS n, count(*) FILTER (WHERE doc_id % 17 <> 0) AS m FROM documents GROUP BY 1) SELECT document_id, document_id = 'src3' OR n <> m AS rebuild FROM n"),
    "h11_themes": (themes, _THEMES),
    "m04_topic_sets": (sets, _sql(f", {_OWN} SELECT term, CASE WHEN bool_or(document_id = 'src1') AND bool_or(document_id = 'src2') THEN 'BOTH' WHEN bool_or(document_id = 'src1') THEN 'FIRST' ELSE 'SECOND' END AS side FROM own WHERE document_id IN ('src1', 'src2') GROUP BY 1")),
    "k05_name_keys": (names, r"SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '', 'g') AS entity_key, regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ſ', 's'), '[^a-z0-9]+', '', 'g') AS name_key FROM documents"),
    "e13_uuid5": (identifiers, _UUID),
    "a02_safe_filename": (filenames, _FILENAMES),
    "b04_redact": (redacted, _REDACTED),
}
