"""Spatial queries over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial as op
from ..operators.paging import paginate
from ..sources import views
from ..sources.views import table

RING = [(-100.0, -50.0), (60.0, -60.0), (120.0, 40.0), (-20.0, 70.0), (-100.0, -50.0)]
HOLE = [(-10.0, -10.0), (30.0, -10.0), (30.0, 20.0), (-10.0, 20.0), (-10.0, -10.0)]


def mine_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.mines(spark, sf_dir).select(F.col("mine_id").alias("id"), F.col("canonical_name").alias("name"), "state", "lon", "lat", "verification_id", "verifier_id")
    return op.spatial_layer(m, _records(spark, sf_dir, "supplier", "s_suppkey"), "MINE")


def _records(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Each point's record; every ninth has another verifier."""
    return table(spark, sf_dir, name).select(F.col(key).alias("record_key"), F.when(F.col(key) % 9 != 0, F.col(key) % 7).alias("verified_by"))


def borehole_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    b = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 71 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 29 % 1700 / 10.0 - 85).alias("lat"), F.col("c_custkey").alias("verification_id"), (F.col("c_custkey") % 7).alias("verifier_id"))
    return op.spatial_layer(b, _records(spark, sf_dir, "customer", "c_custkey"), "BOREHOLE")


def coordinate_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("name"), (F.col("p_partkey") * 17 % 3600 / 10.0 - 180).alias("lon"), (F.col("p_partkey") * 91 % 1700 / 10.0 - 85).alias("lat"), F.col("p_partkey").alias("verification_id"), (F.col("p_partkey") % 7).alias("verifier_id"))
    return op.spatial_layer(c, _records(spark, sf_dir, "part", "p_partkey"), "VERIFIED_COORDINATE")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_layer(spark, sf_dir).unionByName(borehole_layer(spark, sf_dir)).unionByName(coordinate_layer(spark, sf_dir))


_LAYERS = """WITH layers AS (
  SELECT 'MINE' AS entity_type, s_suppkey AS id, s_name AS name, n_name AS state, s_suppkey * 37 % 3600 / 10.0 - 180 AS lon, s_suppkey * 53 % 1600 / 10.0 - 80 AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 0
  UNION ALL SELECT 'BOREHOLE', c_custkey, c_name, NULL, c_custkey * 71 % 3600 / 10.0 - 180, c_custkey * 29 % 1700 / 10.0 - 85 FROM customer WHERE c_custkey % 9 <> 0
  UNION ALL SELECT 'VERIFIED_COORDINATE', p_partkey, 'Verified coordinate ' || p_partkey, NULL, p_partkey * 17 % 3600 / 10.0 - 180, p_partkey * 91 % 1700 / 10.0 - 85 FROM part WHERE p_partkey % 9 <> 0)
"""
_D = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return _D.format(a=lat1, b=lat2, c=lon1, d=lon2)


def all_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).select("entity_type", "id", "name", "state", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_layer(layers(spark, sf_dir), state="NATION_7").select("entity_type", "id")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = layers(spark, sf_dir)
    return op.count_layers(l.where(geo.within_bbox(l.lon, l.lat, -60, -30, 60, 30)))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = layers(spark, sf_dir)
    return l.where(geo.within_bbox(l.lon, l.lat, -60, -30, 60, 30)).select("entity_type", "id")


def polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = layers(spark, sf_dir)
    return l.where(geo.within_polygon(l.lon, l.lat, [RING, HOLE])).select("entity_type", "id")


def polygon_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle whose edges run through points."""
    ring = [(-60.0, -30.0), (60.0, -30.0), (60.0, 30.0), (-60.0, 30.0), (-60.0, -30.0)]
    l = layers(spark, sf_dir)
    return l.select("entity_type", "id", geo.within_polygon(l.lon, l.lat, [ring]).alias("within"), geo.intersects_polygon(l.lon, l.lat, [ring]).alias("intersects")).where("intersects")


def _ray(rings) -> str:
    terms = [f"CASE WHEN ({a[1]} > lat) <> ({b[1]} > lat) AND lon < ({b[0]} - ({a[0]})) * (lat - ({a[1]})) / ({b[1]} - ({a[1]})) + ({a[0]}) THEN 1 ELSE 0 END" for r in rings for a, b in zip(r, r[1:], strict=False) if a[1] != b[1]]
    edges = [f"(abs(({b[0]} - ({a[0]})) * (lat - ({a[1]})) - ({b[1]} - ({a[1]})) * (lon - ({a[0]}))) < 1e-9 AND lon BETWEEN {min(a[0], b[0])} AND {max(a[0], b[0])} AND lat BETWEEN {min(a[1], b[1])} AND {max(a[1], b[1])})" for r in rings for a, b in zip(r, r[1:], strict=False)]
    return "(" + " + ".join(terms) + ") % 2 = 1 AND NOT (" + " OR ".join(edges) + ")"


def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = layers(spark, sf_dir)
    return l.where(geo.within_radius(l.lon, l.lat, 10.0, 20.0, 450_000)).select("entity_type", "id", F.round(geo.haversine(l.lon, l.lat, F.lit(10.0), F.lit(20.0)), 2).alias("distance_m"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nearest(layers(spark, sf_dir), 10.0, 20.0, 25).select("entity_type", "id", F.round("distance_m", 2).alias("distance_m"))


def near_mines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.spatial_candidates(borehole_layer(spark, sf_dir), mine_layer(spark, sf_dir), 300_000).withColumn("distance_m", F.round("distance_m", 2))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.knn(mine_layer(spark, sf_dir), layers(spark, sf_dir), 3, 500_000).select("origin_id", "entity_type", "id", "rank", F.round("distance_m", 2).alias("distance_m"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    asked = c.select(F.lit("BOREHOLE").alias("left_type"), F.col("c_custkey").alias("left_id"), F.lit("MINE").alias("right_type"), F.col("c_nationkey").cast("long").alias("right_id"))
    return op.pair_distances(asked, layers(spark, sf_dir)).select("left_id", "right_id", F.round("distance_m", 2).alias("distance_m"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.to_geojson(layers(spark, sf_dir))
    lon = F.get_json_object("feature_json", "$.geometry.coordinates[0]").cast("double")
    return out.select("entity_type", "id", F.get_json_object("feature_json", "$.geometry.type").alias("kind"), F.round(lon, 6).alias("lon"), F.get_json_object("feature_json", "$.properties.state").alias("state"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text coordinates, some out of range, some no numbers."""
    e = table(spark, sf_dir, "events")
    lat = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.col("event_id") % 100, F.lit(".500")))
    lon = F.concat(F.col("event_id") % 200, F.lit(".2500"))
    p = geo.normalize_point(lat, lon)
    return e.select("event_id", p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), p["geometry_wkt"].alias("wkt"))


_POINTS = """SELECT event_id, CASE WHEN ok THEN a || '.5' END AS latitude, CASE WHEN ok THEN o || '.25' END AS longitude, CASE WHEN ok THEN 'SRID=4326;POINT(' || o || '.25 ' || a || '.5)' END AS wkt
FROM (SELECT event_id, event_id % 100 AS a, event_id % 200 AS o, event_id % 7 <> 0 AND event_id % 100 < 90 AND event_id % 200 < 180 AS ok FROM events)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lat = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise((F.col("event_id") % 100).cast("string"))
    crs = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 1, "EPSG:3857").otherwise("EPSG:4326")
    return e.select("event_id", F.explode(geo.spatial_issues(lat, F.lit("12"), crs, F.col("event_id") % 11 != 0)).alias("issue"))


_ISSUES = """SELECT event_id, 'NOT_NUMERIC' AS issue FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'OUT_OF_RANGE' FROM events WHERE event_id % 7 <> 0 AND event_id % 100 > 90
UNION ALL SELECT event_id, 'CRS_MISSING' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'CRS_UNSUPPORTED' FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, 'GEOMETRY_INVALID' FROM events WHERE event_id % 11 = 0"""


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paginate(near_mines(spark, sf_dir), ("borehole_id", "distance_m"), "distance_m", "borehole_id", 3, 20)
    return out.select("borehole_id", "mine_id", "total", "pages")


_NEAR = _LAYERS.rstrip() + ", near AS (SELECT b.id AS borehole_id, m.id AS mine_id, " + _distance("b.lon", "b.lat", "m.lon", "m.lat") + " AS d FROM layers b JOIN layers m ON b.entity_type = 'BOREHOLE' AND m.entity_type = 'MINE') "

QUERIES = {
    "j04_layers": (all_layers, _LAYERS + "SELECT entity_type, id, name, state, round(lon, 6) AS lon, round(lat, 6) AS lat FROM layers"),
    "c16_filtered_layers": (filtered, _LAYERS + "SELECT entity_type, id FROM layers WHERE entity_type <> 'MINE' OR state ILIKE 'NATION_7'"),
    "j07_layer_counts": (counts, _LAYERS + "SELECT entity_type, count(*) AS n FROM layers WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 GROUP BY 1"),
    "c12_within_box": (box, _LAYERS + "SELECT entity_type, id FROM layers WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30"),
    "c13_within_polygon": (polygon, _LAYERS + f"SELECT entity_type, id FROM layers WHERE {_ray([RING, HOLE])}"),
    "c14_polygon_edges": (polygon_edge, _LAYERS + "SELECT entity_type, id, lon > -60 AND lon < 60 AND lat > -30 AND lat < 30 AS within, true AS intersects FROM layers WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30"),
    "c15_within_radius": (radius, _LAYERS + f"SELECT * FROM (SELECT entity_type, id, round({_distance('lon', 'lat', '10.0', '20.0')}, 2) AS distance_m FROM layers) WHERE distance_m <= 450000"),
    "j05_nearest": (nearest, _LAYERS + f"SELECT entity_type, id, round({_distance('lon', 'lat', '10.0', '20.0')}, 2) AS distance_m FROM layers ORDER BY {_distance('lon', 'lat', '10.0', '20.0')}, entity_type, id LIMIT 25"),
    "d03_boreholes_near_mines": (near_mines, _NEAR + "SELECT 'SPATIAL_CANDIDATE' AS relation_type, false AS established_relationship, borehole_id, mine_id, round(d, 2) AS distance_m, 'm' AS unit FROM near WHERE d <= 300000"),
    "j06_knn": (knn, _LAYERS.rstrip() + ", p AS (SELECT o.id AS origin_id, l.entity_type, l.id, " + _distance("l.lon", "l.lat", "o.lon", "o.lat") + " AS d FROM layers o JOIN layers l ON o.entity_type = 'MINE') SELECT origin_id, entity_type, id, r AS rank, round(d, 2) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY d, entity_type, id) AS r FROM p WHERE d <= 500000) WHERE r <= 3"),
    "d04_pair_distances": (pairs, _LAYERS + "SELECT b.id AS left_id, m.id AS right_id, round(" + _distance("b.lon", "b.lat", "m.lon", "m.lat") + ", 2) AS distance_m FROM customer JOIN layers b ON b.entity_type = 'BOREHOLE' AND b.id = c_custkey JOIN layers m ON m.entity_type = 'MINE' AND m.id = c_nationkey"),
    "b01_geojson": (features, _LAYERS + "SELECT entity_type, id, 'Point' AS kind, round(lon, 6) AS lon, state FROM layers"),
    "j01_normalized_points": (points, _POINTS),
    "j02_spatial_issues": (issues, _ISSUES),
    "c09_page": (page, _NEAR + ", f AS (SELECT *, count(*) OVER () AS total FROM near WHERE d <= 300000) SELECT borehole_id, mine_id, total, ceil(total / 20)::BIGINT AS pages FROM f ORDER BY round(d, 2), borehole_id LIMIT 20 OFFSET 40"),
}
