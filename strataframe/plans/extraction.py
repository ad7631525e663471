"""Extraction queries over text and tables rendered from the supplied rows: the oracle is the rendered columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as op
from ..sources.views import table


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each part: an output, a depth, a mine, a date and a place."""
    p = table(spark, sf_dir, "part")
    day, month = F.col("p_partkey") % 28 + 1, F.col("p_partkey") % 12 + 1
    text = F.concat(
        F.lit("Production: "), F.format_number(F.col("p_partkey") * 7, 0), F.when(F.col("p_partkey") % 2 == 0, " tonnes").otherwise(" kt"), F.lit("; depth "), F.col("p_size").cast("string"), F.lit(".5 metres. Mine: Alpha "),
        F.initcap(F.split("p_name", " ")[0]), F.lit(", dated "), F.lpad(day.cast("string"), 2, "0"), F.lit("/"), F.lpad(month.cast("string"), 2, "0"), F.lit("/2024 at coordinate "), F.col("p_size").cast("string"), F.lit(".25, "), (F.col("p_partkey") % 80).cast("string"), F.lit(".75"),
    )
    return p.select(F.col("p_partkey").alias("unit_id"), text.alias("text"), "p_partkey", "p_size", "p_name")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.extract_quantities(sentences(spark, sf_dir))
    return out.select("unit_id", "candidate_type", F.col("numeric").cast("double").alias("numeric"), "unit")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences with a label for each rule; ``Mineral`` begins with a label of its own."""
    s, word, n = sentences(spark, sf_dir), F.initcap(F.split("p_name", " ")[0]), F.col("p_partkey").cast("string")
    labels = F.concat(F.lit(". Project: Beta "), word, F.lit("; Coal block: Gamma "), word, F.lit("; Borehole no. BH-"), n, F.lit("; Location: Site "), n, F.lit("; Formation: Delta "), word, F.lit("; Seam no. S"), n, F.lit("; Mineral: Ore "), word)
    out = op.extract_entities(s.withColumn("text", F.concat("text", labels)))
    return out.select("unit_id", "candidate_type", "raw_value", F.size("validation").alias("failures"))


_ENTITIES = """WITH p AS (SELECT p_partkey AS k, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS w FROM part)
SELECT k AS unit_id, candidate_type, raw_value, 0 AS failures FROM (
SELECT k, 'mine' AS candidate_type, 'Alpha ' || w AS raw_value FROM p UNION ALL SELECT k, 'mine', 'ral' FROM p UNION ALL SELECT k, 'project', 'Beta ' || w FROM p UNION ALL SELECT k, 'coal_block', 'Gamma ' || w FROM p
UNION ALL SELECT k, 'borehole', 'BH-' || k FROM p UNION ALL SELECT k, 'exploration_location', 'Site ' || k FROM p UNION ALL SELECT k, 'geological_formation', 'Delta ' || w FROM p UNION ALL SELECT k, 'seam', 'S' || k FROM p UNION ALL SELECT k, 'mineral_resource', 'Ore ' || w FROM p)"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extract_dates(sentences(spark, sf_dir)).select("unit_id", "normalized_value", F.size("validation").alias("failures"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extract_coordinates(sentences(spark, sf_dir)).select("unit_id", "normalized_value")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and minutes, with and without hemispheres."""
    p = table(spark, sf_dir, "part")
    a, b, m = (F.col("p_partkey") % 90).cast("string"), (F.col("p_partkey") % 180).cast("string"), (F.col("p_size") % 70).cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(a, F.lit("°"), m, F.lit("'30\"N "), b, F.lit("°"), m, F.lit("'30\"W"))).when(F.col("p_partkey") % 3 == 1, F.concat(b, F.lit("° "), m, F.lit("′, "), a, F.lit("° "), m, F.lit("′"))).otherwise(F.concat(a, F.lit(".5, "), b, F.lit(".25")))
    got = op.parse_pair(raw)
    return p.select("p_partkey", F.round(got["lon"], 6).alias("lon"), F.round(got["lat"], 6).alias("lat"))


_PAIRS = """WITH s AS (SELECT p_partkey, p_partkey % 3 AS k, (p_partkey % 90)::DOUBLE AS a, (p_partkey % 180)::DOUBLE AS b, (p_size % 70)::DOUBLE AS m FROM part),
v AS (SELECT p_partkey, k, m, CASE k WHEN 0 THEN -(b + m / 60 + 30 / 3600.0) WHEN 1 THEN b + m / 60 ELSE CASE WHEN b + 0.25 > 90 THEN b + 0.25 ELSE a + 0.5 END END AS lon,
  CASE k WHEN 0 THEN a + m / 60 + 30 / 3600.0 WHEN 1 THEN a + m / 60 ELSE CASE WHEN b + 0.25 > 90 THEN a + 0.5 ELSE b + 0.25 END END AS lat FROM s)
SELECT p_partkey, CASE WHEN ok THEN round(lon, 6) END AS lon, CASE WHEN ok THEN round(lat, 6) END AS lat FROM (SELECT *, (k = 2 OR m < 60) AND abs(lon) <= 180 AND abs(lat) <= 90 AS ok FROM v)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extraction_summary(op.extract_candidates(sentences(spark, sf_dir)))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.candidate_ids(op.extract_candidates(sentences(spark, sf_dir)).withColumn("document_version_id", F.lit("v1")))
    return out.select("unit_id", "candidate_type", "start", "end", "id")


_SPANS = """t AS (SELECT p_partkey AS k, 'Production: ' || format('{:,}', p_partkey * 7) AS a, CASE WHEN p_partkey % 2 = 0 THEN ' tonnes' ELSE ' kt' END AS u, p_size || '.5 metres' AS d,
  'Mine: Alpha ' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS m, p_size || '.25, ' || (p_partkey % 80) || '.75' AS c FROM part),
w AS (SELECT *, length(a || u) + 8 AS d0, length(a || u) + 8 + length(d) + 2 AS m0 FROM t),
spans AS (SELECT k AS unit_id, 'production_record' AS candidate_type, 12 AS "start", length(a || u) AS "end" FROM w UNION ALL SELECT k, 'measurement', d0, d0 + length(d) FROM w UNION ALL SELECT k, 'mine', m0, m0 + length(m) FROM w
  UNION ALL SELECT k, 'date_time', m0 + length(m) + 8, m0 + length(m) + 18 FROM w UNION ALL SELECT k, 'coordinate', m0 + length(m) + 33, m0 + length(m) + 33 + length(c) FROM w)"""
_IDS = f"""WITH {_SPANS}, h AS (SELECT *, sha1(from_hex('{op.NAMESPACE.replace("-", "")}') || encode('v1|' || unit_id || '|' || candidate_type || '|' || "start" || '|' || "end")) AS h FROM spans)
SELECT unit_id, candidate_type, "start", "end", substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities that stay, with their spans: none lies in a date or a coordinate."""
    c = op.extract_candidates(sentences(spark, sf_dir))
    return c.where(F.col("candidate_type").isin("measurement", "production_record")).select("unit_id", "start", "end")


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.concat(F.lit("Mine-"), F.col("value").cast("int") % 30, F.when(F.col("event_id") % 9 == 0, " Colliery").otherwise(""))
    rows = e.select("event_id", (F.col("user_id") % 40).alias("document_version_id"), F.lit("mine").alias("candidate_type"), names.alias("raw_value"), F.col("event_id").alias("seq"))
    return op.prior_match(rows).select("event_id", "match_status")


_PRIOR = """WITH r AS (SELECT event_id, user_id % 40 AS v, regexp_replace(lower('Mine-' || (trunc(value)::INTEGER % 30) || CASE WHEN event_id % 9 = 0 THEN ' Colliery' ELSE '' END), '[^a-z0-9]+', '', 'g') AS k FROM events)
SELECT a.event_id, CASE WHEN bool_or(b.k = a.k) THEN 'MATCHED' WHEN bool_or(starts_with(a.k, b.k) OR starts_with(b.k, a.k)) THEN 'POSSIBLE_MATCH' ELSE 'UNRESOLVED' END AS match_status FROM r a LEFT JOIN r b ON a.v = b.v AND b.event_id < a.event_id GROUP BY 1"""


def production_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each part: a title, a heading, and two rows of states."""
    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*map(F.lit, ("million tonnes", "kt", "MT", "Rs"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), v.alias("raw_value"))
    cells = F.array(
        cell(0, 0, F.concat(F.lit("Coal production in 2020-21 ("), unit, F.lit(")"))), cell(0, 1, F.lit("")), cell(0, 2, F.lit("")),
        cell(1, 0, F.lit("State")), cell(1, 1, F.lit("Coking coal")), cell(1, 2, F.lit("Growth %")),
        cell(2, 0, F.lit("India")), cell(2, 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))), cell(2, 2, F.lit("3")),
        cell(3, 0, F.lit("Odisha")), cell(3, 1, F.format_number(F.col("p_partkey") * 11, 0)), cell(3, 2, F.lit("4")),
    )
    return p.select(F.col("p_partkey").alias("table_id"), F.inline(cells))


def production_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    defined = table(spark, sf_dir, "part").where("p_partkey % 8 = 2").select(F.col("p_partkey").alias("table_id"))
    defined = defined.withColumns({"definition": F.lit("MT = Million Tonnes"), "definition_page": F.col("table_id") + 1})
    cells = production_cells(spark, sf_dir).withColumn("id", F.concat_ws(".", "table_id", "row_index", "column_index"))
    out = op.production_rows(cells, defined)
    return out.select("table_id", "row_index", F.round(F.col("normalized_value").cast("double"), 3).alias("value"), "period", "commodity", "source_unit", "source_cell_id", "source_row_label", "definition_page", F.transform("source_cells", lambda c: c["cell_id"]).alias("cells"))


_ROWS = """WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 2 THEN 1000000 WHEN p_partkey % 4 = 1 THEN 1000 END AS f, ['million tonnes', 'kt', 'MT', 'Rs'][p_partkey % 4 + 1] AS u, CASE WHEN p_partkey % 8 = 2 THEN (p_partkey + 1)::VARCHAR END AS d FROM part)
SELECT p_partkey AS table_id, 2 AS row_index, round((p_size + 0.5) * f, 3)::DOUBLE AS value, '2020-21' AS period, 'Coking coal' AS commodity, u AS source_unit, p_partkey || '.2.1' AS source_cell_id, 'India' AS source_row_label, d AS definition_page, [p_partkey || '.2.0', p_partkey || '.2.1', p_partkey || '.2.2'] AS cells FROM p WHERE f IS NOT NULL
UNION ALL SELECT p_partkey, 3, (p_partkey * 11 * f)::DOUBLE, '2020-21', 'Odisha — Coking coal', u, p_partkey || '.3.1', 'Odisha', d, [p_partkey || '.3.0', p_partkey || '.3.1', p_partkey || '.3.2'] FROM p WHERE f IS NOT NULL"""


def spatial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("Borehole", "Mine", "Coordinate", "Road"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), v.alias("raw_value"))
    heads = [cell(0, i, F.lit(h)) for i, h in enumerate(("Type", "Name", "Latitude", "Longitude"))]
    lat = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 120).cast("string"))
    row = [cell(1, i, v) for i, v in enumerate((kind, F.col("p_name"), lat, (F.col("p_partkey") % 150).cast("string")))]
    cells = p.select(F.col("p_partkey").alias("table_id"), F.inline(F.array(*heads, *row)))
    cells = cells.withColumn("id", F.concat_ws(".", "table_id", "row_index", "column_index"))
    out = op.spatial_rows(op.table_rows(cells))
    return out.select("table_id", "candidate_type", "display_name", "coordinate_status", "latitude", "longitude", "source_cell_id", F.size("source_cells").alias("n_cells"), F.element_at("metadata", "coordinate_system").alias("coordinate_system"), F.element_at("metadata", "spatial_entity_type").alias("spatial_entity_type"), F.array_join(F.transform("validation", lambda v: v["status"]), ",").alias("checks"))


_SPATIAL = """SELECT p_partkey AS table_id, CASE p_partkey % 4 WHEN 0 THEN 'borehole' WHEN 1 THEN 'mine' ELSE 'coordinate' END AS candidate_type, p_name AS display_name, s AS coordinate_status,
  CASE WHEN s = 'PASSED' THEN (p_partkey % 120)::VARCHAR END AS latitude, CASE WHEN s = 'PASSED' THEN (p_partkey % 150)::VARCHAR END AS longitude,
  p_partkey || '.1.1' AS source_cell_id, 4 AS n_cells, CASE WHEN p_partkey % 5 <> 0 THEN 'EPSG:4326' END AS coordinate_system, ['BOREHOLE', 'MINE', 'COORDINATE'][p_partkey % 4 + 1] AS spatial_entity_type,
  CASE WHEN p_partkey % 5 = 0 AND p_partkey % 4 = 2 THEN 'WARNING,FAILED' ELSE s END AS checks FROM (
  SELECT *, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 4 = 2 THEN 'FAILED' ELSE 'WARNING' END WHEN p_partkey % 120 <= 90 THEN 'PASSED' ELSE 'FAILED' END AS s FROM part WHERE p_partkey % 4 < 3)"""


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.table_rows(production_cells(spark, sf_dir))
    return rows.select("table_id", "row_index", F.element_at("values", "1").alias("second"), F.size("values").alias("n"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_context(production_cells(spark, sf_dir)).select("table_id", "row_index", "column_index", "context")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws(" ", F.col("text"), F.when(F.col("doc_id") % 3 == 0, "MT - Million Tonnes").when(F.col("doc_id") % 3 == 1, "MT is million"))
    return op.unit_definitions(d.select(F.col("source").alias("document_version_id"), F.col("doc_id").alias("page_id"), text.alias("text")))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("page_id"), "text")
    contents = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("id"), "text")
    cells = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("cell_id"), "text")
    used = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("cell_id"))
    return op.source_units(pages, contents, cells, used).select("page_id", "unit_id")


QUERIES = {
    "e01_entities": (entities, _ENTITIES),
    "e02_dates": (dates, "SELECT p_partkey AS unit_id, '2024-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS normalized_value, 0 AS failures FROM part"),
    "e03_quantities": (quantities, "SELECT p_partkey AS unit_id, 'production_record' AS candidate_type, (p_partkey * 7 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 1000 END)::DOUBLE AS numeric, 't' AS unit FROM part UNION ALL SELECT p_partkey, 'measurement', p_size + 0.5, 'm' FROM part"),
    "e05_coordinates": (coordinates, "SELECT p_partkey AS unit_id, p_size || '.25,' || (p_partkey % 80) || '.75' AS normalized_value FROM part"),
    "e05_parsed_pairs": (pairs, _PAIRS),
    "e06_overlaps": (overlaps, f"WITH {_SPANS} SELECT unit_id, \"start\", \"end\" FROM spans WHERE candidate_type IN ('measurement', 'production_record')"),
    "e08_table_rows": (rebuilt, "SELECT p_partkey AS table_id, r AS row_index, CASE r WHEN 1 THEN 'Coking coal' WHEN 2 THEN p_size || '.5' ELSE format('{:,}', p_partkey * 11) END AS second, 3 AS n FROM part, (SELECT unnest([1, 2, 3]) AS r)"),
    "e09_spatial_rows": (spatial_rows, _SPATIAL),
    "e10_production_rows": (production_rows, _ROWS),
    "e11_cell_context": (contexts, """WITH c AS (SELECT p_partkey AS k, 'Coal production in 2020-21 (' || ['million tonnes', 'kt', 'MT', 'Rs'][p_partkey % 4 + 1] || ')' AS t, [['', '', ''], ['State', 'Coking coal', 'Growth %'], ['India', p_size || '.5', '3'], ['Odisha', format('{:,}', p_partkey * 11), '4']] AS v FROM part)
SELECT k AS table_id, (i - 1)::INTEGER AS row_index, (j - 1)::INTEGER AS column_index, CASE WHEN i = 1 AND j = 1 THEN t WHEN j = 1 THEN t || ': ' || v[i][j] ELSE v[i][j] END AS context FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([1, 2, 3]) AS j)"""),
    "e12_source_units": (units, "SELECT doc_id AS page_id, 'content:' || doc_id AS unit_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'cell:' || doc_id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'page:' || doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0"),
    "e13_candidate_ids": (identified, _IDS),
    "e14_prior_match": (prior, _PRIOR),
    "e15_summary": (candidates, f"WITH {_SPANS} SELECT candidate_type, count(*) AS n, 0::BIGINT AS unresolved, 0::BIGINT AS failures FROM spans GROUP BY 1"),
    "d17_unit_definitions": (definitions, "SELECT source AS document_version_id, min(doc_id) AS definition_page FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"),
}
