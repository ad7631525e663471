"""Nearest points through cells of many sizes against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataframe.functions.geo import EARTH_RADIUS_M
from strataframe.operators import spatial

SCHEMA = "entity_type string, id long, lon double, lat double"


def metres(a, b):
    half_lat, half_lon = math.radians(b[1] - a[1]) / 2, math.radians(b[0] - a[0]) / 2
    h = math.sin(half_lat) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("k,radius", [(1, 500_000), (3, 500_000), (8, 20_000)])
def test_nearest_points_of_all_kinds_of_places(spark, k, radius):
    rng = random.Random(k)
    at = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)] + [(80 + rng.gauss(0, 0.01), 20 + rng.gauss(0, 0.01)) for _ in range(200)]
    at += [(x, y) for x in (-180.0, 180.0, 179.999, -179.9995, 0.0) for y in (-90.0, 90.0, 89.9999, 0.0, 84.99, -85.01, 60.0)] + [(10.0, 50.0)] * 30 + [(10.00001, 50.0)] * 4
    layer = [(rng.choice("AB"), i, x, y) for i, (x, y) in enumerate(at)] + [("A", 900, None, 1.0)]
    starts = [("O", i, x, y) for i, (x, y) in enumerate(rng.sample(at, 60) + [(10.0, 50.0), (180.0, 90.0), (-180.0, 0.0), (0.0, 0.0), (80.0, 20.0), (45.0, 84.9)])] + [("O", 70, None, None)]
    rows = spatial.knn(spark.createDataFrame(starts, SCHEMA), spark.createDataFrame(layer, SCHEMA).repartition(5), k, radius).collect()
    got = {}
    for r in rows:
        got.setdefault(r.origin_id, []).append((r["rank"], r.entity_type, r.id))
    for _, i, x, y in starts:
        near = sorted((round(d, 6), t, j) for t, j, lx, ly in layer if x is not None and lx is not None and (d := metres((x, y), (lx, ly))) <= radius)
        mine = [(t, j) for _, t, j in sorted(got.get(i, []))]
        by = {(t, j): d for d, t, j in near}
        assert len(mine) == min(k, len(near)) and [by[m] for m in mine] == pytest.approx([d for d, _, _ in near[:k]], abs=1e-3), (i, x, y)


def test_a_town_does_not_meet_all_its_origins(spark):
    town = spark.range(100_000).select(F.lit("A").alias("entity_type"), "id", (F.lit(80.0) + F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1e6).alias("lon"), (F.lit(20.0) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 1e6).alias("lat"))
    one = spark.range(50_000).select(F.lit("B").alias("entity_type"), (F.col("id") + 200_000).alias("id"), F.lit(80.005).alias("lon"), F.lit(20.005).alias("lat"))
    origins = town.where("id % 500 = 0")
    pairs = spatial.near_pairs(origins, town.unionByName(one), 5, 500_000)
    assert pairs.count() < 0.002 * 200 * 150_000
