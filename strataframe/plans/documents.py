"""Ingest, chunk and index queries over the supplied documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as op
from ..operators.paging import numbered
from ..operators.paging import page_order as page_order_columns
from ..sources import ingest, sinks
from ..sources.views import table
from ..streaming.tables import folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_KINDS = ("pdf", "docx", "xlsx", "xls", "png", "jpg", "jpeg", "tif", "exe")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: kinds by id, every fifth with a wrong MIME type, every seventh with wrong first bytes."""
    d = documents(spark, sf_dir)
    kind = F.col("doc_id") % 9
    formats = {e: (m[0], b[0], entry) for e, m, b, entry in ingest.FORMATS}
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (kind + 1).cast("int"))
    mime = pick([formats.get(k, ("application/octet-stream",))[0] for k in _KINDS])
    magic = pick([formats[k][1] if k in formats else "4D5A" for k in _KINDS])
    entry = pick([f"[Content_Types].xml {formats[k][2]}" if k in formats and formats[k][2] else "" for k in _KINDS])
    head = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("00000000"))).otherwise(F.unhex(magic))
    return d.select("doc_id", F.concat(F.lit("in/é file "), "doc_id", F.lit("."), pick(_KINDS)).alias("name"), F.when(F.col("doc_id") % 5 == 0, "text/plain").otherwise(mime).alias("mime"), F.concat(head, F.encode(entry, "UTF-8"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.admit(files(spark, sf_dir), 20_000).select("doc_id", "safe_name", "status", "reason")


_ADMITTED = """SELECT doc_id, 'e_file_' || doc_id || '.' || k AS safe_name, CASE WHEN reason IS NULL THEN 'ADMITTED' ELSE 'REJECTED' END AS status, reason FROM (
SELECT doc_id, k, CASE WHEN k = 'exe' THEN 'UNSUPPORTED_EXTENSION' WHEN doc_id % 5 = 0 THEN 'MIME_MISMATCH'
  WHEN n > 20000 THEN 'TOO_LARGE' WHEN doc_id % 7 = 0 THEN 'SIGNATURE_MISMATCH' END AS reason FROM (
  SELECT doc_id, ['pdf', 'docx', 'xlsx', 'xls', 'png', 'jpg', 'jpeg', 'tif', 'exe'][doc_id % 9 + 1] AS k,
    CASE WHEN doc_id % 7 = 0 THEN 4 ELSE [5, 4, 4, 8, 8, 3, 3, 4, 2][doc_id % 9 + 1] END + CASE doc_id % 9 WHEN 1 THEN 37 WHEN 2 THEN 35 ELSE 0 END + strlen(coalesce(text, '')) AS n FROM documents))"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", ingest.size_gate(F.octet_length("text"), 10_000).alias("reason"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = d.where("doc_id < 100").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    return ingest.dedup_by_checksum(d.where("doc_id >= 100"), known, "doc_id", "text", "doc_id").select("doc_id", "surviving_id", "duplicate")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("id"))
    return o.select("id", F.col("o_custkey").alias("document_id"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("version_number"))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_version(versions(spark, sf_dir))


def ocr_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", ingest.needs_ocr(F.col("text"), 120).alias("needed"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scanned words."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 50).alias("page"), (F.col("p_partkey") % 7).alias("block"), F.lit(0).alias("par"), (F.col("p_partkey") % 3).alias("line"), F.col("p_partkey").alias("word"), F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.col("p_name")).alias("text"), (F.col("p_size") - 3).cast("double").alias("conf"), (F.col("p_partkey") % 100).alias("left"), (F.col("p_partkey") % 90).alias("top"), F.col("p_size").alias("width"), F.lit(10).alias("height"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ocr_lines(words(spark, sf_dir))


_LINES = """l AS (SELECT p_partkey % 50 AS page, p_partkey % 7 AS block, 0 AS par, p_partkey % 3 AS line, string_agg(p_name, ' ' ORDER BY p_partkey) AS text,
  round(avg(CASE WHEN p_size >= 3 THEN p_size - 3 END) / 100, 4) AS confidence, min(p_partkey % 100) AS x0, min(p_partkey % 90) AS y0, max(p_partkey % 100 + p_size) AS x1, max(p_partkey % 90 + 10) AS y1
  FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1, 2, 3, 4)"""


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ocr_pages(lines(spark, sf_dir)).select("page", F.length("text").alias("n"), F.round("confidence", 3).alias("confidence"))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("page_number"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"sheet_index": '), F.col("user_id") % 5, F.lit("}"))).alias("metadata"), F.col("event_id").alias("created_at"))
    return numbered(p, page_order_columns(), "position").select("event_id", "position")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: a header row and a row for each different line number, three columns."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"))
    body = l.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"), F.posexplode(F.array(F.concat(F.lit("line "), "l_linenumber"), F.col("p").cast("string"), F.col("q").cast("string"))).alias("column_index", "raw_value"))
    head = l.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_index"), F.posexplode(F.array(F.lit("Item"), F.lit(""), F.lit("Output (tonnes)"))).alias("column_index", "raw_value"))
    return head.unionByName(body).withColumns({"normalized_value": F.lit(None).cast("string"), "table_order": (F.col("table_id") % 5 + 1).cast("int")})


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.grid_guard(cells(spark, sf_dir), 18)


_L = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity)::INTEGER AS q FROM lineitem GROUP BY 1, 2)"


def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.table_row_text(cells(spark, sf_dir))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunk_text(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ordinal", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("hash"))


_CHUNKED = r"""WITH RECURSIVE c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS clean FROM documents),
r(doc_id, clean, n, s, e, i) AS (
  SELECT doc_id, clean, length(clean), 0, 0, -1 FROM c WHERE length(clean) > 0
  UNION ALL
  SELECT doc_id, clean, n, s, CASE WHEN s + 3000 < n AND b > 1500 THEN s + b + CASE WHEN substr(w, b + 1, 1) = '.' THEN 1 ELSE 0 END ELSE least(s + 3000, n) END, i FROM (
    SELECT *, greatest(length(w) - length(regexp_extract(w, '[^\n]*$')) - 1, CASE WHEN regexp_matches(w, '(?s)\. ') THEN length(regexp_extract(w, '(?s)^(.*)\. ', 1)) ELSE -1 END, length(w) - length(regexp_extract(w, '[^ ]*$')) - 1) AS b FROM (
      SELECT doc_id, clean, n, s, i, substr(clean, s + 1, 3000) AS w FROM (SELECT doc_id, clean, n, CASE WHEN i < 0 THEN 0 ELSE greatest(s + 1, e - 300) END AS s, i + 1 AS i FROM r WHERE e < n))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ordinal, length(part) AS n, sha256(part) AS hash FROM (SELECT doc_id, i, regexp_replace(substr(clean, s + 1, e - s), '^\s+|\s+$', '', 'g') AS part FROM r WHERE i >= 0) WHERE part <> ''"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, with identity; a source is a version."""
    d = documents(spark, sf_dir)
    version = F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.regexp_replace("source", "[^0-9]", ""), 12, "0"))
    own = op.chunk_text(d.select("doc_id", version.alias("document_version_id"), F.col("doc_id").alias("source_unit_id"), F.lit("PAGE").alias("source_unit_type"), F.col("doc_id").alias("page_number"), F.lit("SOURCE_DOCUMENT").alias("evidence_type"), "text"))
    return op.chunk_ids(own).drop("text")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "ordinal", "chunk_id", "token_count", "character_count")


_IDENTITIES = f"""SELECT doc_id, ordinal, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
  greatest(1, n // 4)::INTEGER AS token_count, n::INTEGER AS character_count FROM (SELECT *, sha1(from_hex('00000000000050008000' || lpad(regexp_replace(source, '[^0-9]', '', 'g'), 12, '0')) || encode('PAGE:' || doc_id || ':' || ordinal || ':' || hash)) AS h FROM ({_CHUNKED}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id))"""


def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunk_index(chunks(spark, sf_dir)).select("chunk_id", "document_version_id", "chunk_index")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document, with vectors for some."""
    d = documents(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    own = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_version_id"), F.col("text").alias("chunk"))
    joined = own.join(v, (F.col("chunk_id") == F.col("vec_id")) & (F.col("vec_id") % 3 != 0), "left")
    return joined.select("chunk_id", "document_version_id", "chunk", "embedding", F.col("embedding").isNotNull().alias("is_indexed"), F.when(F.col("embedding").isNotNull(), F.when(F.col("chunk_id") % 10 == 1, "old").otherwise("m1")).alias("embedding_model"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dimension"))


_FIRST = """f AS (SELECT doc_id AS chunk_id, source AS document_version_id, text AS chunk, embedding, vec_id IS NOT NULL AS is_indexed,
  CASE WHEN vec_id IS NOT NULL THEN CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE 'm1' END END AS model, len(embedding) AS dim FROM documents LEFT JOIN embeddings ON doc_id = vec_id AND vec_id % 3 <> 0)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _first(spark, sf_dir).where("chunk_id % 4 <> 0")
    new = documents(spark, sf_dir).where("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("new text")).otherwise(F.col("text")).alias("chunk"))
    return op.merge_chunks(old, new, "m1", 64).select("chunk_id", "change", "is_indexed", F.col("embedding").isNotNull().alias("has_vector"))


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.removed_chunks(_first(spark, sf_dir), documents(spark, sf_dir).where("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"))).select("chunk_id")


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.needs_embedding(_first(spark, sf_dir), "m1", 64).select("chunk_id")


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first(spark, sf_dir)
    v = f.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("id"), F.when(F.col("chunk_id") % 6 == 0, F.lit("stale")).otherwise(F.sha2("chunk", 256)).alias("text_hash"), F.array(F.lit(0.5).cast("float"), F.when(F.col("chunk_id") % 10 == 0, F.lit(float("nan"))).otherwise(0.5).cast("float")).alias("vector"))
    return op.attach_vectors(f, v, "m2", 2).select("chunk_id", "is_indexed", "embedding_model", "embedding_dimension")


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 7 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("inf")).cast("float")))).otherwise(F.col("embedding"))
    return v.select("vec_id", op.valid_vector(cut, 64).alias("valid"))


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first(spark, sf_dir).withColumn("chunk", F.when(F.col("chunk_id") % 8 == 0, F.lit("  ")).otherwise(F.col("chunk")))
    return op.lexical_index(f).select("chunk_id", "is_indexed")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_progress(_first(spark, sf_dir))


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first(spark, sf_dir)
    return op.clear_vectors(f, "src1", "m1", 64, 10**9).unionByName(op.clear_vectors(f.withColumn("embedding_model", F.lit("m1")), "src2", "m1", 64, 0)).groupBy("document_version_id").agg(F.count("embedding").alias("n_vectors"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("N"), "s_nationkey")).alias("state"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("commodity"), F.col("p_size").alias("value"))
    return op.trusted_text("Mine", s, ["canonical_name", "state"]).unionByName(op.trusted_text("Production", p, ["commodity", "value"]))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sinks.csv_safe(e.select("event_id", F.concat(F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "'", "a"])), (F.col("event_id") % 6 + 1).cast("int")), "event_type").alias("cell")))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return sinks.new_rows(e.where("id % 2 = 0").unionByName(e.where("id % 4 = 0")), e.where("id % 3 = 0"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as text spans of lines of blocks of pages."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    spans = p.select((k % 50).alias("page_id"), (k % 7).alias("block_index"), (k % 3).alias("line_index"), k.alias("span_index"), k.alias("id"), F.col("p_name").alias("text"))
    return op.span_blocks(spans).select("page_id", "block_index", "text", F.size("source_unit_ids").alias("n_spans"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: every third has contents, every fifth a table row."""
    d = documents(spark, sf_dir)
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8").alias("document_version_id"), F.col("doc_id").alias("page_number"), "text")
    contents = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("id"), F.lit("content").alias("text"))
    rows = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("table_id"), F.lit("row").alias("text"))
    out = op.page_chunks(pages, contents, rows, 40_000, 0)
    return out.select("page_id", "source_unit_type", "ordinal", "character_count")


def intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intel import intelligence_input

    d = documents(spark, sf_dir)
    c = d.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 40).alias("page_id"), (F.col("doc_id") % 7 != 0).alias("is_indexed"), F.concat(F.lit('{"page_number": '), F.col("doc_id") % 9 + 1, F.lit("}")).alias("metadata"))
    pages = d.where("doc_id < 30").select(F.col("doc_id").alias("page_id"), (F.col("doc_id") + 100).cast("int").alias("page_number"))
    return intelligence_input(c, pages).select("chunk_id", "page_number")


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions written, then those of one written anew with fewer rows."""
    at = folder(spark)
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("document_version_id"))
    ingest.write_pages(d, at)
    ingest.write_pages(d.where("document_version_id = 'src1' AND doc_id % 40 = 1"), at)
    return spark.read.parquet(at).select("doc_id", F.col("document_version_id").cast("string").alias("document_version_id"))


def appended_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log, then by id so that a repeat adds nothing."""
    at = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    sinks.append_only(e.where("id % 2 = 0"), at)
    for _ in range(2):
        sinks.append_new(e, at)
    return spark.read.parquet(at)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("report_id")).agg(F.count(F.lit(1)).alias("n_items"))
    sinks.write_report(o, at)
    return spark.read.schema("title string, n_items long, report_id string").json(at)


QUERIES = {
    "a06_rewritten_versions": (rewritten, "SELECT doc_id, source AS document_version_id FROM documents WHERE source <> 'src1' OR doc_id % 40 = 1"),
    "b02_written_report": (reported, "SELECT o_orderpriority AS title, o_orderstatus AS report_id, count(*) AS n_items FROM orders GROUP BY 1, 2"),
    "b05_append_only": (appended_twice, "SELECT event_id AS id, event_type FROM events"),
    "d06_intelligence_input": (intelligence, "SELECT doc_id AS chunk_id, (CASE WHEN doc_id % 40 < 30 AND doc_id % 40 IN (SELECT doc_id FROM documents) THEN doc_id % 40 + 100 ELSE doc_id % 9 + 1 END)::INTEGER AS page_number FROM documents WHERE doc_id % 7 <> 0"),
    "f02_span_blocks": (blocks, "SELECT page_id, block_index, string_agg(line, chr(10) ORDER BY l) AS text, sum(n)::INTEGER AS n_spans FROM (SELECT p_partkey % 50 AS page_id, p_partkey % 7 AS block_index, p_partkey % 3 AS l, string_agg(p_name, '' ORDER BY p_partkey) AS line, count(*) AS n FROM part GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "f04_page_chunks": (paged, r"WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS clean FROM documents) SELECT doc_id AS page_id, 'PAGE' AS source_unit_type, 0 AS ordinal, length(clean) AS character_count FROM c WHERE doc_id % 3 <> 0 AND length(clean) > 0 UNION ALL SELECT doc_id, 'CONTENT', 0, 7 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'TABLE_ROW', 0, 3 FROM documents WHERE doc_id % 5 = 0"),
    "a01_admit": (admitted, _ADMITTED),
    "a03_size_gate": (gated, "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 'EMPTY' WHEN strlen(text) > 10000 THEN 'TOO_LARGE' END AS reason FROM documents"),
    "a04_exact_dedup": (deduplicated, "WITH k AS (SELECT coalesce(text, '') AS t, min(doc_id) AS k FROM documents WHERE doc_id < 100 GROUP BY 1), f AS (SELECT coalesce(text, '') AS t, min(doc_id) AS f FROM documents WHERE doc_id >= 100 GROUP BY 1) SELECT doc_id, coalesce(k, f) AS surviving_id, doc_id <> coalesce(k, f) AS duplicate FROM documents d JOIN f ON f.t = coalesce(d.text, '') LEFT JOIN k ON k.t = f.t WHERE doc_id >= 100"),
    "a05_latest_version": (latest_versions, "SELECT max(o_orderkey) AS id, o_custkey AS document_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS version_number FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY 2, 3"),
    "a07_needs_ocr": (ocr_needed, r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) < 120 AS needed FROM documents"),
    "a08_ocr_lines": (lines, f"WITH {_LINES} SELECT * FROM l"),
    "a08_ocr_pages": (ocr_pages, f"WITH {_LINES} SELECT page, length(string_agg(text, chr(10))) AS n, round(round(avg(confidence), 4), 3) AS confidence FROM l GROUP BY 1"),
    "a09_page_order": (page_order, "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 <> 0 THEN user_id END NULLS LAST, CASE WHEN event_id % 2 = 0 THEN user_id % 5 END NULLS LAST, event_id) - 1 AS position FROM events"),
    "a10_grid_guard": (grids, f"WITH {_L} SELECT l_orderkey AS table_id, max(l_linenumber)::BIGINT + 1 AS n_rows, 3::BIGINT AS n_columns, (max(l_linenumber) + 1) * 3 <= 18 AS allowed FROM l GROUP BY 1"),
    "f01_chunks": (chunked, _CHUNKED),
    "f03_table_row_text": (row_texts, f"WITH {_L} SELECT l_orderkey AS table_id, l_linenumber AS row_index, 'Table ' || (l_orderkey % 5 + 1) || ', row ' || (l_linenumber + 1) || '. Headers: Item | Column 2 | Output (tonnes). Item: line ' || l_linenumber || ' | Column 2: ' || p || ' | Output (tonnes): ' || q AS text FROM l"),
    "f05_chunk_ids": (identities, _IDENTITIES),
    "f06_chunk_index": (chunk_numbers, f"SELECT chunk_id, document_version_id, (row_number() OVER (PARTITION BY document_version_id ORDER BY doc_id, ordinal) - 1)::INTEGER AS chunk_index FROM ({_IDENTITIES}) JOIN (SELECT doc_id, '00000000-0000-5000-8000-' || lpad(regexp_replace(source, '[^0-9]', '', 'g'), 12, '0') AS document_version_id FROM documents) USING (doc_id)"),
    "f07_trusted_text": (trusted, "SELECT s_suppkey AS id, 'Mine' AS entity_type, 'Mine. canonical_name: ' || s_name || CASE WHEN s_suppkey % 3 <> 0 THEN '; state: N' || s_nationkey ELSE '' END AS text, 'TRUSTED_CANONICAL_DATA' AS evidence_type FROM supplier UNION ALL SELECT p_partkey, 'Production', 'Production. commodity: ' || p_name || '; value: ' || p_size, 'TRUSTED_CANONICAL_DATA' FROM part"),
    "f08_merge_chunks": (merged, f"WITH {_FIRST}, n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new text' ELSE text END AS chunk FROM documents WHERE doc_id % 7 <> 0), m AS (SELECT n.doc_id, f.*, f.chunk IS NOT DISTINCT FROM n.chunk AND f.chunk_id IS NOT NULL AS same, coalesce(model = 'm1' AND dim = 64, false) AS fits FROM n LEFT JOIN (SELECT * FROM f WHERE chunk_id % 4 <> 0) f ON f.chunk_id = n.doc_id) SELECT doc_id AS chunk_id, CASE WHEN chunk_id IS NULL THEN 'ADDED' WHEN NOT same THEN 'CHANGED' WHEN is_indexed <> fits THEN 'FLAGGED' ELSE 'KEPT' END AS change, same AND fits AS is_indexed, same AND embedding IS NOT NULL AS has_vector FROM m"),
    "f08_removed_chunks": (removed, "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 7 = 0"),
    "c11_needs_embedding": (stale, f"WITH {_FIRST} SELECT chunk_id FROM f WHERE embedding IS NULL OR model <> 'm1' OR dim <> 64"),
    "f09_valid_vector": (valid, "SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS valid FROM embeddings"),
    "f10_attach_vectors": (attached, f"WITH {_FIRST} SELECT chunk_id, g OR is_indexed AS is_indexed, CASE WHEN g THEN 'm2' ELSE model END AS embedding_model, (CASE WHEN g THEN 2 ELSE dim END)::INTEGER AS embedding_dimension FROM (SELECT *, chunk_id % 2 = 0 AND chunk_id % 6 <> 0 AND chunk_id % 10 <> 0 AS g FROM f)"),
    "f11_lexical_index": (lexical, f"WITH {_FIRST} SELECT chunk_id, chunk_id % 8 <> 0 AND length(trim(chunk, ' ')) > 0 AS is_indexed FROM f"),
    "f12_clear_vectors": (cleared, f"WITH {_FIRST} SELECT document_version_id, 2 * count(embedding) AS n_vectors FROM f GROUP BY 1"),
    "f13_index_progress": (progress, f"WITH {_FIRST} SELECT document_version_id, count(*) AS n_chunks, count(embedding) AS n_vectors FROM f GROUP BY 1"),
    "b03_csv_safe": (csv_rows, "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN '''' ELSE '' END || ['=', '+', '-', '@', '''', 'a'][event_id % 6 + 1] || event_type AS cell FROM events"),
    "b06_new_rows": (appended, "SELECT event_id AS id, event_type FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0"),
}
