"""Spatial layers and distance joins over WGS84 points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import METRES_PER_DEGREE, geojson_point, haversine


def spatial_layer(df: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """Verified points of one kind: ``(entity_type, id, name, state, lon, lat)``."""
    verified = df.join(records, F.col("verification_id") == F.col("record_key")).where((F.col("verified_by") == F.col("verifier_id")) & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    state = F.col("state") if "state" in df.columns else F.lit(None).cast("string")
    return verified.select(F.lit(kind).alias("entity_type"), F.col("id").cast("long").alias("id"), F.coalesce("name", F.concat(F.lit("Verified coordinate "), F.col("id"))).alias("name"), state.alias("state"), "lon", "lat")


def filter_layer(df: DataFrame, entity_type: str | None = None, entity_id: int | None = None, state: str | None = None) -> DataFrame:
    """A state narrows mines only."""
    if entity_type:
        df = df.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        df = df.where(F.col("id") == entity_id)
    return df.where((F.col("entity_type") != "MINE") | F.ilike(F.col("state"), F.lit(state))) if state else df


def _cells(lon: Column, lat: Column, radius_m: float) -> tuple[Column, Column, float]:
    """Cell column and row of a point, for cells no smaller than the radius in latitude."""
    step = max(radius_m / METRES_PER_DEGREE * 1.01, 1e-4)
    return F.floor((lon + 180) / step), F.floor((lat + 90) / step), step


def distance_join(a: DataFrame, b: DataFrame, radius_m: float, a_prefix: str = "a_", b_prefix: str = "b_") -> DataFrame:
    """Pairs of points at most ``radius_m`` apart, with ``distance_m``.

    Each row of ``b`` is copied to the cells around it and meets the rows of ``a`` in a hash join. The neighbourhood widens
    with latitude, to the whole ring near the poles, and wraps at the antimeridian.
    """
    if not 0 < radius_m <= 500_000:
        raise ValueError("a radius is over 0 and at most 500000 metres")
    left = a.select(*[F.col(c).alias(f"{a_prefix}{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"{b_prefix}{c}") for c in b.columns])
    x, y, step = _cells(F.col(f"{a_prefix}lon"), F.col(f"{a_prefix}lat"), radius_m)
    around = math.ceil(360 / step)
    left = left.withColumns({"_x": F.pmod(x, F.lit(around)), "_y": y})
    bx, by, _ = _cells(F.col(f"{b_prefix}lon"), F.col(f"{b_prefix}lat"), radius_m)
    reach = F.least(F.lit(89.9), F.abs(F.col(f"{b_prefix}lat")) + step)
    wide = F.least(F.ceil(F.lit(1.02) / F.cos(F.radians(reach))) + 1, F.lit(around // 2 + 1)).cast("long")
    right = right.withColumn("_ny", F.explode(F.sequence(by - 1, by + 1))).withColumn("_nx", F.explode(F.array_distinct(F.transform(F.sequence(bx - wide, bx + wide), lambda v: F.pmod(v, F.lit(around))))))
    joined = left.join(right, (F.col("_x") == F.col("_nx")) & (F.col("_y") == F.col("_ny")))
    d = haversine(F.col(f"{a_prefix}lon"), F.col(f"{a_prefix}lat"), F.col(f"{b_prefix}lon"), F.col(f"{b_prefix}lat"))
    return joined.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("_x", "_y", "_nx", "_ny")


def spatial_candidates(boreholes: DataFrame, mines: DataFrame, radius_m: float) -> DataFrame:
    """Boreholes near mines, as candidates and never as established relations."""
    near = distance_join(boreholes, mines, radius_m, "borehole_", "mine_")
    return near.select(F.lit("SPATIAL_CANDIDATE").alias("relation_type"), F.lit(False).alias("established_relationship"), "borehole_id", "mine_id", "distance_m", F.lit("m").alias("unit"))


def nearest(df: DataFrame, lon: float, lat: float, k: int) -> DataFrame:
    """The ``k`` points nearest to one; ties by type and id."""
    return df.withColumn("distance_m", haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))).orderBy("distance_m", "entity_type", "id").limit(k)


#: Degrees of a cell at each level of the grid for nearest points; a whole number of each goes round the earth.
LEVELS = [8.0 / 4**j for j in range(9)]


def _at_levels(df: DataFrame, lon: str, lat: str, levels: int) -> DataFrame:
    """A row for each level with ``level`` and the cell ``x, y``."""
    out = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_step", F.lit(LEVELS[0]) / F.pow(F.lit(4.0), F.col("level")))
    around = F.round(F.lit(360.0) / F.col("_step")).cast("long")
    return out.withColumns({"x": F.pmod(F.floor((F.col(lon) + 180) / F.col("_step")), around), "y": F.floor((F.col(lat) + 90) / F.col("_step"))}).drop("_step")


def near_pairs(origins: DataFrame, layer: DataFrame, k: int, max_radius_m: float) -> DataFrame:
    """Pairs of an origin and a layer's point that hold the ``k`` nearest of each origin within ``max_radius_m``, and few others.

    Cells of nine sizes are counted. An origin's finest cell that holds ``k`` points bounds the distance of its ``k``-th
    nearest by the cell's diagonal, so only cells four times as wide and around it are searched, or those of the radius where no
    cell holds so many. Of the points of one place the ``k`` first by type and id can rank, others are not paired.
    """
    if not 0 < max_radius_m <= 500_000:
        raise ValueError("a radius is over 0 and at most 500000 metres")
    place = Window.partitionBy("lon", "lat").orderBy("entity_type", "id")
    points = layer.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")
    full = _at_levels(points.select("lon", "lat"), "lon", "lat", len(LEVELS)).groupBy("level", "x", "y").count().where(F.col("count") >= k)
    starts = origins.select(*[F.col(c).alias(f"origin_{c}") for c in origins.columns]).where("origin_lon IS NOT NULL AND origin_lat IS NOT NULL")
    places = starts.select("origin_lon", "origin_lat").distinct()
    finest = _at_levels(places, "origin_lon", "origin_lat", len(LEVELS)).join(full, ["level", "x", "y"], "left_semi").where(F.abs("origin_lat") <= 85).groupBy(F.col("origin_lon").alias("_lon"), F.col("origin_lat").alias("_lat")).agg(F.max("level").alias("_finest"))
    known = starts.join(finest, (F.col("origin_lon") == F.col("_lon")) & (F.col("origin_lat") == F.col("_lat")), "left").drop("_lon", "_lat")
    side = F.lit(LEVELS[0]) / F.pow(F.lit(4.0), F.col("_finest"))
    reach = F.least(F.coalesce(side * math.sqrt(2) * METRES_PER_DEGREE * 1.001, F.lit(max_radius_m)), F.lit(max_radius_m))
    known = known.withColumns({"_reach": reach, "level": F.greatest(F.coalesce(F.col("_finest"), F.lit(0)) - 1, F.lit(0))})
    step = F.lit(LEVELS[0]) / F.pow(F.lit(4.0), F.col("level"))
    around = F.round(F.lit(360.0) / step).cast("long")
    degrees = F.col("_reach") / METRES_PER_DEGREE * 1.01
    ring, top = F.floor(around / 2) + 1, F.abs("origin_lat") + degrees  # near a pole, where cells are the widest, all of the ring
    wide = F.when(top >= 89, ring).otherwise(F.least(F.ceil(degrees * 1.05 / (step * F.cos(F.radians(F.least(F.lit(89.0), top))))), ring)).cast("long")
    own_x, own_y = F.floor((F.col("origin_lon") + 180) / step), F.floor((F.col("origin_lat") + 90) / step)
    searched = known.withColumn("_ny", F.explode(F.sequence(own_y - 1, own_y + 1))).withColumn("_nx", F.explode(F.array_distinct(F.transform(F.sequence(own_x - wide, own_x + wide), lambda v: F.pmod(v, around))))).withColumnRenamed("level", "_level")
    cells = _at_levels(points, "lon", "lat", len(LEVELS) - 1)
    met = cells.join(searched, (F.col("level") == F.col("_level")) & (F.col("x") == F.col("_nx")) & (F.col("y") == F.col("_ny")))
    distance = haversine(F.col("lon"), F.col("lat"), F.col("origin_lon"), F.col("origin_lat"))
    return met.withColumn("distance_m", distance).where(F.col("distance_m") <= F.col("_reach")).drop("level", "x", "y", "_level", "_nx", "_ny", "_finest", "_reach")


def knn(origins: DataFrame, layer: DataFrame, k: int, max_radius_m: float) -> DataFrame:
    """The ``k`` nearest points of each origin within ``max_radius_m``, ranked from 1; ties by type and id. See :func:`near_pairs`."""
    near = near_pairs(origins, layer, k, max_radius_m)
    w = Window.partitionBy("origin_id").orderBy("distance_m", "entity_type", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_distances(pairs: DataFrame, layer: DataFrame) -> DataFrame:
    """``distance_m`` of ``pairs (left_type, left_id, right_type, right_id)``; pairs with a missing end fall out."""
    l = layer.select(F.col("entity_type").alias("lt"), F.col("id").alias("li"), F.col("lon").alias("llon"), F.col("lat").alias("llat"))
    r = layer.select(F.col("entity_type").alias("rt"), F.col("id").alias("ri"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    joined = pairs.join(l, (F.col("left_type") == F.col("lt")) & (F.col("left_id") == F.col("li"))).join(r, (F.col("right_type") == F.col("rt")) & (F.col("right_id") == F.col("ri")))
    return joined.select(*pairs.columns, haversine(F.col("llon"), F.col("llat"), F.col("rlon"), F.col("rlat")).alias("distance_m"))


def count_layers(df: DataFrame) -> DataFrame:
    return df.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def to_geojson(df: DataFrame) -> DataFrame:
    """``(id, feature_json)``: one GeoJSON feature for each point."""
    properties = F.struct(F.col("state"), F.lit("EPSG:4326").alias("coordinate_system"), F.lit("VERIFIED").alias("verification_status"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.col("entity_type"), F.col("name"), geojson_point(F.col("lon"), F.col("lat")).alias("geometry"), properties.alias("properties"))
    return df.select("entity_type", "id", F.to_json(feature).alias("feature_json"))
