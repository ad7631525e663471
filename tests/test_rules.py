"""Rules with known outcomes: names, files, coordinates, units, tables, searches."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strataframe.functions import text
from strataframe.operators import canonical, extract, paging, production, review, search

NAMES = ["Łódź Čapek Şahin", "Mine-Á 7", "Ｍｉｎｅ ﬁve Ⅷ ½ km²", "Straße ſ K", "é e\u0301 q\u0301 ñ", "", "日本 12", None]


def column(spark, values, function, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    plain = lambda s: "".join(c for c in s if c.isascii() and c.isalnum())
    fold = [None if n is None else plain(unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().casefold()) for n in NAMES]
    assert column(spark, NAMES, text.entity_key) == fold and fold[0] == "odzcapeksahin"
    join = [None if n is None else plain(unicodedata.normalize("NFKC", n).casefold()) for n in NAMES]
    assert column(spark, NAMES, text.mention_key) == join


def test_file_names(spark):
    names = {r"C:\dir\Bérïcht (1).PDF": "Bericht_1.pdf", "///": "document", "a" * 200 + ".pdf": "a" * 160 + ".pdf", "--x-- .docx": "x.docx", "…/.hidden": "hidden", "plan.v2.xlsx": "plan.v2.xlsx", "日本.pdf": "pdf.pdf"}
    assert dict(zip(names, column(spark, list(names), text.safe_filename), strict=True)) == names


def test_mentions(spark):
    rows = [(1, "v", "mine", "Mine A"), (2, "v", "mine", "Mine-A"), (3, "v", "mine", "Mine A Colliery"), (4, "v", "mine", "Different"), (5, "w", "mine", "Mine A"), (6, "v", "mine", "Diff"), (7, "v", "mine", None), (8, "v", "mine", "ＭＩＮＥ Ａ"), (9, "v", "mine", "")]
    df = spark.createDataFrame(rows, "seq int, document_version_id string, candidate_type string, raw_value string")
    got = {r.seq: r.match_status for r in extract.prior_match(df).collect()}
    assert got == {1: "UNRESOLVED", 2: "MATCHED", 3: "POSSIBLE_MATCH", 4: "UNRESOLVED", 5: "UNRESOLVED", 6: "POSSIBLE_MATCH", 7: "POSSIBLE_MATCH", 8: "MATCHED", 9: "MATCHED"}


def test_coordinates(spark):
    rows = [(1, "10", "20", "wgs 84", None), (2, "10", "20", "4326", None), (3, "10", "20", None, None), (4, "10", "20", " ", "20.5, 11.25"), (5, "10", "20", "WGS-84", None), (6, "91", "20", "EPSG:4326", None), (7, None, None, "", "11°15'0\"N 20°30'0\"E")]
    df = spark.createDataFrame(rows, "id int, lat string, lon string, crs string, accepted string")
    got = {r.id: (r.reason, r.wkt) for r in canonical.publish_coordinates(df, "accepted").select("id", "reason", F.col("point.geometry_wkt").alias("wkt")).collect()}
    at = "SRID=4326;POINT(20 10)"
    assert got == {1: (None, at), 2: (None, at), 3: (None, at), 4: (None, "SRID=4326;POINT(20.5 11.25)"), 5: ("CRS_UNSUPPORTED", at), 6: ("INVALID_POINT", None), 7: (None, "SRID=4326;POINT(20.5 11.25)")}


@pytest.mark.parametrize("kind,a,ua,b,ub,value,status", [
    ("production_difference", "12", "t", "10", "Mt", -9999988.0, "ok"), ("growth_percentage", "120", "tonnes", "100", "t", 20.0, "ok"), ("production_share", "25", "t", "100", "tonnes", 25.0, "ok"),
    ("growth_percentage", "1", "t", "0", "t", None, "zero_denominator"), ("production_share", "1", "t", "0", "t", None, "zero_denominator"), ("production_difference", None, "t", "1", "t", None, "missing_input"),
    ("stripping_ratio", "400", "t", "100", "tonnes", 4.0, "ok"), ("productivity", "600", "t", "30", "man-shift", 20.0, "ok"), ("productivity", "1", "t", "0", "man-shift", None, "zero_denominator"),
    ("productivity", "1", "t", "2", "t", None, "wrong_dimension"), ("production_difference", "1", "t", "2", "Rs", None, "incompatible_units"), ("production_difference", "1", "t", "2", "MT", None, "unsupported_unit"),
])
def test_calculations_with_units(spark, kind, a, ua, b, ub, value, status):
    df = spark.createDataFrame([(a, ua, b, ub)], "a string, ua string, b string, ub string")
    out = production.with_units(df, kind, "a", "ua", "b", "ub")
    assert out.columns == [*df.columns, "result"]
    r = out.first().result
    assert (r.value, r.status) == (value, status)


def cells(spark, rows):
    return spark.createDataFrame([(1, i, r, c, v) for i, r, c, v in rows], "table_id int, id string, row_index int, column_index int, raw_value string")


def test_spatial_tables(spark):
    heads = ["Entity Type", "Name", "Latitude", "Longitude", "Depth (m)", "State"]
    body = [["BOREHOLE", "BH-01", "23.74", "86.41", "12", "Odisha"], ["VERIFIED_COORDINATE", "Mine Point A", "23.748", "86.412", None, ""], ["COORDINATE", "Bad", "x", "1", None, None], ["COORDINATE", "Half", "1", None, None, None], ["MINE", "Far", "99", "1", None, None]]
    rows = [(f"{r}.{c}", r, c, v) for r, line in enumerate([heads, *body]) for c, v in enumerate(line)]
    got = {r.display_name: r for r in extract.spatial_rows(extract.table_rows(cells(spark, rows))).collect()}
    a, b = got["BH-01"], got["Mine Point A"]
    assert (a.candidate_type, a.raw_value, a.metadata["latitude"], a.metadata["longitude"], a.metadata["depth"], a.metadata["state"], a.source_cell_id) == ("borehole", "BH-01", "23.74", "86.41", "12", "Odisha", "1.1")
    assert (b.candidate_type, b.raw_value, b.metadata["coordinate_system"], b.source_cell_id) == ("coordinate", "86.412,23.748", "EPSG:4326", "2.1")
    assert {c.header: c.cell_id for c in b.source_cells}["Longitude"] == "2.3" and b.validation[0].status == "PASSED"
    assert [v.status for v in got["Bad"].validation] == ["FAILED"] and [v.status for v in got["Half"].validation] == ["WARNING", "FAILED"] and [v.status for v in got["Far"].validation] == ["FAILED"]


def test_production_tables_need_a_definition(spark):
    lines = [["Production of Raw Coal in 2024-25 (MT)", "", "", ""], ["Sector", "Coking", "Non-Coking", "Total Coal"], ["All India", "66.470", "981.053", "1047.523"]]
    table = cells(spark, [(f"{r}.{c}", r, c, v) for r, line in enumerate(lines) for c, v in enumerate(line)])
    assert extract.production_rows(table).count() == 0
    defined = spark.createDataFrame([(1, "MT = Million Tonnes", "glossary")], "table_id int, definition string, definition_page string")
    r = extract.production_rows(table, defined).where("raw_value = '1047.523'").first()
    assert (float(r.normalized_value), r.unit, r.period, r.commodity, r.definition, r.definition_page, r.source_cell_id, r.source_unit) == (1047523000.0, "t", "2024-25", "Total Coal", "MT = Million Tonnes", "glossary", "2.3", "MT")


def test_queue_search(spark):
    cands = spark.createDataFrame([(1, 7, None, "mine", "x", "x", "x", "MINE"), (2, 8, 5, "mine", "y", "y", "y", "MINE"), (3, None, None, "mine", "12", None, "z", "MINE")], "id int, page_id int, content_id int, candidate_type string, raw_value string, normalized_value string, raw_text string, classification string")
    pages = spark.createDataFrame([(7, 12, "plan"), (8, 3, "map")], "page_id int, page_number int, document_name string")
    contents = spark.createDataFrame([(5, "the North seam")], "content_id int, content_text string")
    find = lambda q: sorted(r.id for r in review.queue_search(cands, pages, contents, q).collect())
    assert (find("12"), find("NORTH"), find("pla_"), find("seam"), find("none")) == ([1, 3], [2], [1], [2], [])


def test_near_identities(spark):
    known = [f"Mine Alpha {i:04d}" for i in range(1, 30)]
    e = spark.createDataFrame([(i, n, [], None, None, None, None) for i, n in enumerate(known)], "entity_id int, canonical_name string, aliases array<string>, domain_code string, parent string, lat double, lon double")
    asked = ["Mine Alpha 0500", "Mine Alphas 0007", "Min Alpha 0011", "Other", "mine alpha 00"]
    c = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(asked)], "id int, name string, code string, parent string, lat double, lon double")
    got = {r.id: (r.identity_status, r.entity_id) for r in review.resolve_identity(c, e).collect()}
    key = lambda s: "".join(x for x in s.lower() if x.isalnum())
    for i, n in enumerate(asked):
        scores = [(SequenceMatcher(None, key(n), key(k)).ratio(), -j) for j, k in enumerate(known)]
        best, j = max(scores)
        assert got[i] == (("POSSIBLE_MATCH", -j) if best >= 0.88 else ("NEW", None)), n


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    chunks = spark.createDataFrame([(i, f"coal {'seam ' * (i % 3)} {i}", [float(i % 5), 1.0], True) for i in range(40)] + [(99, "coal", [0.0, 0.0], True)], "chunk_id int, chunk string, embedding array<float>, is_indexed boolean")
    queries = spark.createDataFrame([(i, q, [1.0, float(i)]) for i, q in enumerate(["coal", "coal seam", "seam 7", "nothing", "7", "coal seam 7", ""])], "query_id int, query string, vector array<float>")
    scores = {(r.query_id, r.chunk_id): r.semantic_score for r in search.semantic_scores(queries, chunks).collect()}
    words = {(r.query_id, r.chunk_id): r.lexical_score for r in search.lexical_scores(queries, chunks).collect()}
    assert len(scores) == 7 * 41
    got = {}
    for r in search.hybrid_topk(queries, chunks, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    for q in range(7):
        ranked = sorted(((-(0.7 * (scores[q, c] or 0.0) + 0.3 * words.get((q, c), 0.0)), c) for c in [*range(40), 99]), key=lambda x: (round(x[0], 12), x[1]))
        assert [c for _, c in sorted(got[q])] == [c for _, c in ranked[:6]]


def test_numbered(spark):
    df = spark.range(500).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1000)))
    rows = paging.numbered(df, [F.col("k"), F.col("id")], "n").collect()
    assert [(r.k, r.id) for r in sorted(rows, key=lambda r: r.n)] == sorted((r.k, r.id) for r in rows) and sorted(r.n for r in rows) == list(range(500))
    assert paging.numbered(df.limit(0), [F.col("k")], "n").count() == 0


def test_deep_pages_read_little(spark):
    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("k")).repartition(3)
    df = df.unionByName(df.limit(100))  # repeated rows count once
    path = paging.keep_pages(df, ("k",), "k", "id", ranges=150)
    want = sorted(((r.k is None, r.k or 0, r.id) for r in df.distinct().collect()))
    for page, size in ((1, 3), (10_000, 3), (57, 500), (60, 500), (61, 500)):
        out = paging.read_page(df, path, page, size)
        rows = sorted(out.collect(), key=lambda r: r.position)
        assert [r.id for r in rows] == [x[2] for x in want[(page - 1) * size : page * size]]
        assert all(r.total == 30_000 and r.pages == 30_000 // size for r in rows)
    files = paging.read_page(df, path, 5_000, 3).inputFiles()
    assert spark.read.parquet(*files).count() < 0.02 * 30_000 and len(files) <= 2
    assert not paging.read_page(df.limit(0), paging.keep_pages(df.limit(0), ("k",), "k", "id"), 1, 5).count()


def test_files_in_and_out(spark, tmp_path):
    from strataframe.sources import ingest, sinks

    df = spark.createDataFrame([(1, "=1+1", '{"type": "Feature"}'), (2, "plain", "{}")], "id int, note string, feature_json string")
    sinks.write_csv(df.select("id", "note"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("1", "'=1+1"), ("2", "plain")]
    sinks.write_features(df, str(tmp_path / "features"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "features")).collect()) == ['{"type": "Feature"}', "{}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1")
    assert [(r.name, bytes(r.content)) for r in ingest.read_files(spark, str(tmp_path / "in")).collect()] == [("a.pdf", b"%PDF-1")]
