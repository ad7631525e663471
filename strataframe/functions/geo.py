"""Points, distances and areas on WGS84 coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_195.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the sphere."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def plain_decimal(text: Column) -> Column:
    """A decimal's text without exponent and without trailing zeros; null if it is none."""
    number = text.cast("string").try_cast("decimal(38,18)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(trimmed, r"^-0$", "0")


def normalize_point(lat: Column, lon: Column, srid: Column | None = None) -> Column:
    """``struct(latitude, longitude, srid, geometry_wkt)`` as text, null if a coordinate is no number, out of range or in another system."""
    y, x = (c.cast("string").try_cast("decimal(38,18)") for c in (lat, lon))
    fine = y.between(-90, 90) & x.between(-180, 180) & (F.lit(True) if srid is None else srid == 4326)
    lat_text, lon_text = plain_decimal(lat), plain_decimal(lon)
    return F.when(fine, F.struct(lat_text.alias("latitude"), lon_text.alias("longitude"), F.lit(4326).alias("srid"), F.concat(F.lit("SRID=4326;POINT("), lon_text, F.lit(" "), lat_text, F.lit(")")).alias("geometry_wkt")))


def spatial_issues(lat: Column, lon: Column, crs: Column, valid: Column | None = None) -> Column:
    """Array of the codes of what is wrong: ``NOT_NUMERIC``, ``OUT_OF_RANGE``, ``CRS_MISSING``, ``CRS_UNSUPPORTED``, ``GEOMETRY_INVALID``."""
    y, x = (c.cast("string").try_cast("double") for c in (lat, lon))
    number = y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x) & (F.abs(y) < float("inf")) & (F.abs(x) < float("inf"))
    none = crs.isNull() | (crs == "")
    return F.array_compact(F.array(
        F.when(~number, "NOT_NUMERIC"),
        F.when(number & ~(y.between(-90, 90) & x.between(-180, 180)), "OUT_OF_RANGE"),
        F.when(none, "CRS_MISSING"),
        F.when(~none & (crs != "EPSG:4326"), "CRS_UNSUPPORTED"),
        F.when(~(F.lit(True) if valid is None else valid), "GEOMETRY_INVALID"),
    ))


def within_bbox(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Edges included. Boxes over the antimeridian or without area are refused."""
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("a box needs -180 <= west < east <= 180 and -90 <= south < north <= 90")
    return lon.between(west, east) & lat.between(south, north)


def check_rings(rings: list[list[tuple[float, float]]]) -> None:
    """Rings are closed, have four points at least and lie on the globe; the first is the outline, others are holes."""
    if not rings:
        raise ValueError("a polygon needs a ring")
    for ring in rings:
        if len(ring) < 4 or tuple(ring[0]) != tuple(ring[-1]):
            raise ValueError("a ring is closed and has four points at least")
        if any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in ring):
            raise ValueError("a ring's points lie on the globe")


def _edges(rings: list[list[tuple[float, float]]]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True)]) for ring in rings for a, b in zip(ring, ring[1:], strict=False)])


def _box(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    xs, ys = zip(*rings[0], strict=True)
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))


def _on_boundary(lon: Column, lat: Column, edges: Column) -> Column:
    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
        return (F.abs(cross) < 1e-9) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(edges, on)


def _odd_crossings(lon: Column, lat: Column, edges: Column) -> Column:
    def crossed(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def within_polygon(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside the outline and outside the holes; the boundary is not inside."""
    check_rings(rings)
    edges = _edges(rings)
    return _box(lon, lat, rings) & ~_on_boundary(lon, lat, edges) & _odd_crossings(lon, lat, edges)


def intersects_polygon(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside, or on the boundary of the outline or of a hole."""
    check_rings(rings)
    edges = _edges(rings)
    return _box(lon, lat, rings) & (_on_boundary(lon, lat, edges) | _odd_crossings(lon, lat, edges))


def within_radius(lon: Column, lat: Column, at_lon: float, at_lat: float, radius_m: float) -> Column:
    """At most ``radius_m`` (over 0, at most 500 km) away; a latitude band comes before the trigonometry."""
    if not 0 < radius_m <= 500_000:
        raise ValueError("a radius is over 0 and at most 500000 metres")
    band = radius_m / METRES_PER_DEGREE * 1.01
    return lat.between(at_lat - band, at_lat + band) & (haversine(lon, lat, F.lit(at_lon), F.lit(at_lat)) <= radius_m)


def geojson_point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
