"""Search and evidence queries over the supplied documents and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as op
from ..operators.postings import keep_postings
from ..sources.views import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk; those with a vector of the same number are indexed."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = d.join(v, d.doc_id == v.vec_id, "left")
    return joined.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "source", F.col("lang").alias("content_type"), F.col("text").alias("chunk"), "embedding", F.col("embedding").isNotNull().alias("is_indexed"), F.when(F.col("doc_id") % 5 == 0, "TRUSTED_CANONICAL_DATA").otherwise("SOURCE_DOCUMENT").alias("evidence_type"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries: their first one to three different words, with the vector of the same number."""
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    words = F.array_distinct(op.words(F.col("text")))
    return b.join(v, b.item_id == v.vec_id).select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), " ").alias("query"), F.col("embedding").alias("vector"))


_SCORES = """q AS (SELECT item_id AS query_id, embedding AS v, list_distinct_words[1] AS a, CASE WHEN item_id % 3 > 0 THEN list_distinct_words[2] END AS b, CASE WHEN item_id % 3 > 1 THEN list_distinct_words[3] END AS c FROM (
  SELECT item_id, embedding, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_words FROM (SELECT item_id, embedding, regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+') AS w FROM benchmark b JOIN embeddings ON item_id = vec_id))),
c AS (SELECT doc_id AS chunk_id, vec_id, embedding, text FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
s AS (SELECT query_id, chunk_id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN c ON vec_id IS NOT NULL)"""
#: The same over English source documents alone.
_SCORES_EN = _SCORES.replace("ON doc_id = vec_id),\ns AS", "ON doc_id = vec_id WHERE lang = 'en' AND doc_id % 5 <> 0),\ns AS")
# a cover ends at every place where all words have been seen and the last place of the one seen longest ago has moved
_LEXICAL = """, p AS (SELECT chunk_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM c)),
h AS (SELECT query_id, chunk_id, word, pos, a, b, c FROM q JOIN p ON word = a UNION ALL SELECT query_id, chunk_id, word, pos, a, b, c FROM q JOIN p ON word = b UNION ALL SELECT query_id, chunk_id, word, pos, a, b, c FROM q JOIN p ON word = c),
n AS (SELECT *, max(pos) FILTER (word = a) OVER w AS la, max(pos) FILTER (word = b) OVER w AS lb, max(pos) FILTER (word = c) OVER w AS lc, 1 + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER AS m FROM h WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN la IS NOT NULL AND (b IS NULL OR lb IS NOT NULL) AND (c IS NULL OR lc IS NOT NULL) THEN least(la, lb, lc) END AS start FROM n),
e AS (SELECT *, lag(start) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS before FROM g),
l AS (SELECT query_id, chunk_id, sum(1.0 / (pos - start + 2 - m)) AS r FROM e WHERE start IS NOT NULL AND (before IS NULL OR start > before) GROUP BY 1, 2),
x AS (SELECT query_id, chunk_id, r / (1 + r) AS lexical FROM l)"""


def _ranked(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.semantic_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.lexical_scores(queries(spark, sf_dir), chunks(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.round("lexical_score", 6).alias("score"))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lexical_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 10, pad=True).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hybrid_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def filtered_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best among the chunks that filters leave."""
    c = op.filter_chunks(chunks(spark, sf_dir), content_type="en", evidence_types=["SOURCE_DOCUMENT"])
    return op.hybrid_topk(queries(spark, sf_dir), c, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches in one kept index: one after another, each for every second query."""
    c, q = chunks(spark, sf_dir), queries(spark, sf_dir)
    index = keep_postings(c)
    every = [op.lexical_scores(q.where(F.col("query_id") % 2 == i), c, index) for i in (0, 1)]
    return every[0].unionByName(every[1]).select("query_id", "chunk_id", F.round("lexical_score", 6).alias("score"))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_chunks(chunks(spark, sf_dir), document_id="src1", content_type="en", evidence_types=["SOURCE_DOCUMENT"]).select("chunk_id")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.semantic_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 8).join(chunks(spark, sf_dir).select("chunk_id", "document_id", "evidence_type", "chunk"), "chunk_id")


_HITS = f"WITH {_SCORES}, hits AS (SELECT r.*, d.text AS chunk, d.source AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'TRUSTED_CANONICAL_DATA' ELSE 'SOURCE_DOCUMENT' END AS evidence_type FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) r JOIN documents d ON doc_id = chunk_id WHERE rank <= 8)"


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir).select(F.col("document_id")).distinct().withColumn("document_name", F.concat(F.lit("file-"), "document_id"))
    return op.chunk_context(op.semantic_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 8), chunks(spark, sf_dir), docs).select("query_id", "chunk_id", "document_name")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.label(op.trusted_first(_hits(spark, sf_dir), 5)).select("query_id", "chunk_id", "citation_id")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pack_context(_hits(spark, sf_dir), budget=9000).select("query_id", "chunk_id", "rank", F.length("context").alias("n"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fallback_answer(_hits(spark, sf_dir), chars=300).select("query_id", F.sha2("answer", 256).alias("hash"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search_audit(_hits(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.element_at(F.array(*map(F.lit, ("verified total", "mine in the report", "production of seam", "page text", "how many mines near", "x"))), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(words, F.lit(" "), F.col("text")).alias("text"))


_ROUTED = "r AS (SELECT conv_id, turn, ['verified total', 'mine in the report', 'production of seam', 'page text', 'how many mines near', 'x'][(conv_id + turn) % 6 + 1] || ' ' || text AS text FROM conversations WHERE role = 'user')"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.route_questions(routed(spark, sf_dir)).select("conv_id", "turn", "valid", "trusted_requested", "calculation")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.analysis_flags(routed(spark, sf_dir)).select("conv_id", "turn", "numeric", "spatial")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = routed(spark, sf_dir).withColumn("query_id", F.col("conv_id"))
    return op.question_status(q, op.semantic_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 8)).select("conv_id", "turn", "status")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = c.select("conv_id", "turn", F.concat(F.lit("text "), F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("[E"), F.col("conv_id") % 4 + 1, F.lit("]")))).alias("answer"), F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")).alias("allowed"))
    return op.check_citations(a).select("conv_id", "turn", "citations_ok")


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir).withColumns({"document_version_id": F.col("document_id"), "source_unit_id": F.when(F.col("chunk_id") % 4 != 0, F.col("chunk_id"))})
    return op.traceable(h).select("query_id", F.col("provenance.chunk_id").alias("chunk_id"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = _hits(spark, sf_dir).select("query_id", "chunk_id", F.col("document_id").alias("page_id"), F.col("chunk_id").alias("source_unit_id"), "chunk", F.lit(None).cast("long").alias("table_id"), F.lit(None).cast("int").alias("row_index"))
    pages = d.select(F.col("source").alias("page_id")).distinct().withColumn("page_text", F.concat(F.lit("page "), "page_id"))
    units = d.select(F.col("source").alias("page_id"), F.col("doc_id").alias("unit_id"), F.concat(F.lit("unit "), "doc_id").alias("unit_text"), F.col("doc_id").alias("unit_order"))
    cells = spark.createDataFrame([], "table_id long, row_index int, column_index int, cell_text string")
    return op.with_evidence(h, pages, units, cells).select("query_id", "chunk_id", F.sha2("exact_source_text", 256).alias("hash"))


QUERIES = {
    "g01_semantic_topk": (semantic, f"WITH {_SCORES} {_ranked('s', 10)}"),
    "g02_lexical_scores": (lexical, f"WITH {_SCORES}{_LEXICAL} SELECT query_id, chunk_id, round(lexical, 6) AS score FROM x"),
    "g02_lexical_padded": (padded, f"WITH {_SCORES}{_LEXICAL} SELECT * FROM (SELECT query_id, chunk_id, round(coalesce(lexical, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(lexical, 0) DESC, chunk_id) AS rank FROM (SELECT query_id, q_c.chunk_id, lexical FROM (SELECT query_id, chunk_id FROM q CROSS JOIN (SELECT chunk_id FROM c)) q_c LEFT JOIN x USING (query_id, chunk_id))) WHERE rank <= 10"),
    "g03_hybrid_topk": (hybrid, f"WITH {_SCORES}{_LEXICAL}, y AS (SELECT s.query_id, s.chunk_id, 0.7 * score + 0.3 * coalesce(lexical, 0) AS score FROM s LEFT JOIN x USING (query_id, chunk_id)) {_ranked('y', 10)}"),
    "g03_filtered_topk": (filtered_hybrid, f"WITH {_SCORES_EN}{_LEXICAL}, y AS (SELECT s.query_id, s.chunk_id, 0.7 * score + 0.3 * coalesce(lexical, 0) AS score FROM s LEFT JOIN x USING (query_id, chunk_id)) {_ranked('y', 10)}"),
    "g02_kept_index": (indexed, f"WITH {_SCORES}{_LEXICAL} SELECT query_id, chunk_id, round(lexical, 6) AS score FROM x"),
    "c10_filtered_chunks": (filtered, "SELECT doc_id AS chunk_id FROM documents WHERE source = 'src1' AND lang = 'en' AND doc_id % 5 <> 0"),
    "d05_chunk_context": (context, f"{_HITS} SELECT query_id, chunk_id, 'file-' || document_id AS document_name FROM hits"),
    "d12_evidence": (evidence, f"{_HITS}, u AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), t AS (SELECT h.query_id, h.chunk_id, string_agg('unit ' || u.doc_id, chr(10) ORDER BY r) FILTER (WHERE u.doc_id <> h.chunk_id) AS units FROM hits h JOIN u ON u.source = h.document_id AND r <= 10 GROUP BY 1, 2) SELECT query_id, chunk_id, sha256(substr(chunk || chr(10) || 'page ' || document_id || chr(10) || units, 1, 24000)) AS hash FROM hits JOIN t USING (query_id, chunk_id)"),
    "g05_traceable": (traced, f"{_HITS} SELECT query_id, chunk_id FROM hits WHERE chunk_id % 4 <> 0"),
    "g06_routes": (routes, f"WITH {_ROUTED} SELECT conv_id, turn, length(text) BETWEEN 1 AND 1000 AS valid, regexp_matches(text, '(?i)\\b(verified|trusted|canonical|recorded)\\b') OR (regexp_matches(text, '(?i)\\b(production|mine|project|borehole|seam|block)\\b') AND NOT regexp_matches(text, '(?i)\\b(source|document|report|page|text|according to)\\b')) AS trusted_requested, regexp_matches(text, '{op.CALCULATION}') AS calculation FROM r"),
    "g07_trusted_first": (trusted, f"{_HITS} SELECT query_id, chunk_id, 'E' || r AS citation_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence_type <> 'TRUSTED_CANONICAL_DATA', score DESC, chunk_id) AS r FROM hits) WHERE r <= 5"),
    "g09_packed_context": (packed, f"{_HITS} SELECT query_id, chunk_id, rank, least(length(chunk), 9000 - used)::INTEGER AS n FROM (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits) WHERE used < 9000"),
    "g10_citations": (citations, "SELECT conv_id, turn, turn % 3 <> 0 AND conv_id % 4 < 3 AS citations_ok FROM conversations WHERE role = 'assistant'"),
    "g11_question_status": (statuses, f"WITH {_ROUTED} SELECT conv_id, turn, CASE WHEN conv_id NOT IN (SELECT item_id FROM benchmark JOIN embeddings ON item_id = vec_id) THEN 'INSUFFICIENT_EVIDENCE' WHEN regexp_matches(text, '{op.CALCULATION}') THEN 'DETERMINISTIC_CALCULATION_REQUIRED' ELSE 'EVIDENCE_ONLY' END AS status FROM r"),
    "g12_fallback_answer": (answers, f"{_HITS} SELECT query_id, sha256(string_agg('[E' || rank || '] ' || substr(chunk, 1, 300), chr(10) || chr(10) ORDER BY rank)) AS hash FROM hits GROUP BY 1"),
    "g13_search_audit": (audit, f"{_HITS} SELECT query_id, count(*) AS n_results, list(chunk_id ORDER BY rank) AS result_ids, 'COMPLETED' AS status FROM hits GROUP BY 1"),
    "g14_analysis_flags": (flags, f"WITH {_ROUTED} SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(production|output|total|average|trend|growth|tonnes?|compare)\\b') AS numeric, regexp_matches(text, '(?i)\\b(near|nearest|distance|location|coordinates?|map|within|spatial)\\b') AS spatial FROM r"),
}
