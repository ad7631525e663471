import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from strataframe.functions import geo, text
from strataframe.operators import chunk, extract, intel, spatial


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x"))).first()[0]


def test_points(spark):
    df = spark.createDataFrame([("12.500", "77.2500"), ("91", "0"), ("0", "181"), ("NaN", "0"), ("inf", "0"), (None, "1"), ("0", "-0.0")], "lat string, lon string")
    got = [r.p and r.p.geometry_wkt for r in df.select(geo.normalize_point(F.col("lat"), F.col("lon")).alias("p")).collect()]
    assert got == ["SRID=4326;POINT(77.25 12.5)", None, None, None, None, None, "SRID=4326;POINT(0 0)"]


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert 111_000 < d < 111_300


def test_polygons(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 5.0), (0.0, 5.0), (4.0, 5.0), (11.0, 5.0)], "x double, y double")
    got = [tuple(r) for r in df.select(geo.within_polygon(df.x, df.y, [ring, hole]), geo.intersects_polygon(df.x, df.y, [ring, hole])).collect()]
    assert got == [(True, True), (False, False), (False, True), (False, True), (False, False)]
    for bad in ([], [[(0, 0), (1, 1), (0, 0)]], [[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(0, 0), (200, 0), (1, 1), (0, 0)]]):
        with pytest.raises(ValueError):
            geo.within_polygon(df.x, df.y, bad)


def test_distance_join_is_the_theta_join(spark):
    rng = random.Random(3)
    pts = lambda n: [(i, rng.choice([rng.uniform(-180, 180), 179.99, -179.99]), rng.choice([rng.uniform(-90, 90), 89.9, -89.8])) for i in range(n)]
    a, b = (spark.createDataFrame(pts(150), "id int, lon double, lat double") for _ in range(2))
    near = {(r.a_id, r.b_id) for r in spatial.distance_join(a, b, 400_000).collect()}
    x, y = a.toDF("a_id", "lon1", "lat1"), b.toDF("b_id", "lon2", "lat2")
    all_ = {(r.a_id, r.b_id) for r in x.crossJoin(y).where(geo.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) <= 400_000).collect()}
    assert near == all_ and near


def test_uuid5_and_names(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, "é name", lambda c: text.uuid5(F.lit(ns), c)) == str(uuid.uuid5(uuid.UUID(ns), "é name"))
    assert one(spark, "Mine-Á 7", text.entity_key) == "minea7" and one(spark, "Mine-Á 7", text.name_key) == "mine7"
    assert one(spark, r"C:\dir\Bérïcht (1).pdf", text.safe_filename) == "Bericht_1.pdf" and one(spark, "///", text.safe_filename) == "document"
    assert one(spark, "=HYPERLINK(1)", text.formula_safe) == "'=HYPERLINK(1)" and one(spark, "a=1", text.formula_safe) == "a=1"
    assert one(spark, "see record_id 6ba7b811-9dad-11d1-80b4-00c04fd430c8 now", text.redact) == "see now"


def test_keywords_and_topics(spark):
    rows = [("a", 1, 1, "Coal production from underground mining. Coal production."), ("b", 2, 2, "coal seam"), ("a", 1, 3, "coal seam"), ("b", 2, 4, None)]
    c = spark.createDataFrame(rows, "document_id string, page_id int, chunk_id int, text string")
    coal = intel.keywords(c.where("chunk_id = 1")).where("term = 'coal'").first()
    assert (coal.frequency, coal.token_frequency) == (1, 2)
    seam = intel.topics(c).where("term = 'coal seam'").first()
    assert (seam.document_count, seam.confidence) == (2, 1.0)
    classes = {r.term: r["class"] for r in intel.compare_documents(c).collect()}
    assert classes["coal seam"] == "COMMON" and classes["coal production"] == "DOCUMENT_SPECIFIC"


def split(text, max_chars, overlap):
    """The rule, restated."""
    clean = "\n".join(line.strip() for line in text.replace("\r", "\n").split("\n") if line.strip()).strip()
    parts, start = [], 0
    while start < len(clean):
        end = min(start + max_chars, len(clean))
        if end < len(clean):
            bound = max(clean.rfind(m, start, end) for m in ("\n", ". ", " "))
            if bound > start + max_chars // 2:
                end = bound + (clean[bound] == ".")
        if clean[start:end].strip():
            parts.append(clean[start:end].strip())
        if end >= len(clean):
            break
        start = max(start + 1, end - overlap)
    return parts


def test_chunks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é. .\n\r  ") for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", " \n ", "x" * 500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.c for r in df.select("i", chunk.chunks_of(F.col("text"), 100, 20).alias("c")).collect()}
    assert all((got[i] or []) == split(t or "", 100, 20) for i, t in enumerate(texts))
    with pytest.raises(ValueError):
        chunk.chunks_of(F.col("x"), 100, 60)


def test_chunk_ids(spark):
    df = spark.createDataFrame([("00000000-0000-5000-8000-000000000001", "PAGE", "7", 0, "text é")], "document_version_id string, source_unit_type string, source_unit_id string, ordinal int, chunk string")
    r = chunk.chunk_ids(df).first()
    name = f"PAGE:7:0:{hashlib.sha256('text é'.encode()).hexdigest()}"
    assert r.chunk_id == str(uuid.uuid5(uuid.UUID(r.document_version_id), name)) and (r.token_count, r.character_count) == (1, 6)


@pytest.mark.parametrize("raw", ["20.5, 11.25", "11°15'0\"N 20°30'0\"E", "11°15'N, 20°30'E", "11°15′0″N 20°30′0″E"])
def test_coordinates(spark, raw):
    r = one(spark, raw, extract.parse_pair)
    assert (r.lon, r.lat) == (20.5, 11.25)


def test_quantities(spark):
    df = spark.createDataFrame([(1, "Production: 1,250 tonnes; depth 12.5 metres; grade 8 furlongs"), (2, "Production: -2 tonnes"), (3, "on 12/03/2024 and 5 of 7"), (4, None)], "unit_id int, text string")
    got = {(r.unit_id, r.candidate_type, r.raw_value, None if r.numeric is None else float(r.numeric), r.unit, len(r.validation)) for r in extract.extract_quantities(df).collect()}
    assert got == {(1, "production_record", "1,250", 1250.0, "t", 0), (1, "measurement", "12.5", 12.5, "m", 0), (1, "measurement", "8", None, None, 0), (2, "production_record", "-2", -2.0, "t", 1)}


def test_dates(spark):
    df = spark.createDataFrame([(1, "31/02/2024"), (2, "2024-03-05"), (3, "5 Mar 2024"), (4, "05-03-24")], "unit_id int, text string")
    assert {r.unit_id: (r.normalized_value, len(r.validation)) for r in extract.extract_dates(df).collect()} == {1: (None, 1), 2: ("2024-03-05", 0), 3: ("2024-03-05", 0), 4: ("2024-03-05", 0)}


def test_prior_match(spark):
    df = spark.createDataFrame([("v", "mine", "Mine A", 1), ("v", "mine", "Mine-A", 2), ("v", "mine", "Mine A Colliery", 3), ("v", "mine", "Other", 4)], "document_version_id string, candidate_type string, raw_value string, seq int")
    assert [r.match_status for r in extract.prior_match(df).orderBy("seq").collect()] == ["UNRESOLVED", "MATCHED", "POSSIBLE_MATCH", "UNRESOLVED"]


def test_production_table(spark):
    cells = [(1, 0, 0, "Coal production 2024-25 (MT)"), (1, 1, 0, "Type"), (1, 1, 1, "Total Coal"), (1, 2, 0, "All India"), (1, 2, 1, "1,047.523")]
    df = spark.createDataFrame(cells, "table_id int, row_index int, column_index int, raw_value string")
    assert extract.production_rows(df).count() == 0
    r = extract.production_rows(df, spark.createDataFrame([(1,)], "table_id int")).first()
    assert (float(r.normalized_value), r.period, r.commodity) == (1_047_523_000.0, "2024-25", "Total Coal")


def test_texts_are_searched_once_for_all_spans(spark):
    df = spark.createDataFrame([(1, "Mine: Alpha; depth 12.5 metres at 20.5, 11.25 on 05/03/2024")], "unit_id int, text string")
    for extract_ in (extract.extract_entities, extract.extract_dates, extract.extract_quantities, extract.extract_coordinates):
        plan = extract_(df)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("regexp_extract_all") <= 2 and "aggregate(" not in plan, extract_.__name__


def test_found_spans_are_those_of_column_expressions(spark):
    texts = ["Größe 12.5 m² an 3/4/2024², mine: Élan Ä", "éMT = Million Tonnes", "e\u0301MT - Million Tonnes MT: million tonnes", "½ MT = Million Tonnes ½", None, "", "😀 20.5, 11.25 😀 11°15'N, 20°30'E ¼mine Alpha", "١٢ 12 tonnes, K mine: B\u2028C"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    patterns = {"date": extract.DATE, "quantity": extract.QUANTITY, "pair": extract.PAIR, "dms": extract.DMS, "definition": extract.UNIT_DEFINITION, **extract.ENTITY_RULES}
    rows = extract.found(df, patterns).collect()
    for name, pattern in patterns.items():
        known = {r.i: r.m for r in df.select("i", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)).alias("m")).collect()}
        for r in rows:
            assert [m.raw for m in r[name]] == known[r.i], (name, r.text)
            assert all(r.text[m.start : m.end] == m.raw for m in r[name])
