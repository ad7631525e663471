"""Typed, traceable candidates from text and tables, as column expressions over source units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import mention_key, uuid5
from ..functions.units import EXTRACTION_UNITS, normalize_units

#: Fixed value: the namespace of identifiers.
NAMESPACE = "03ae188d-b4a5-4344-a3bb-829b0ad16d8e"

# The rules' patterns.
_NAME = r"([A-Z][\w&'()./-]*(?:\s+[A-Z][\w&'()./-]*){0,5})"
ENTITY_RULES = {
    "mine": rf"(?i)\b(?:mine|colliery)\s*(?:name\s*)?[:\-]?\s*{_NAME}",
    "project": rf"(?i)\bproject\s*(?:name\s*)?[:\-]?\s*{_NAME}",
    "coal_block": rf"(?i)\b(?:coal\s+block|block)\s*(?:name\s*)?[:\-]?\s*{_NAME}",
    "borehole": r"(?i)\b(?:borehole|bore\s*hole|BH)\s*(?:no\.?|id|identifier)?\s*[:#\-]?\s*([A-Z0-9][A-Z0-9_./-]{0,30})",
    "exploration_location": r"(?i)\b(?:exploration\s+location|location)\s*[:\-]\s*([^,;\n]{2,100})",
    "geological_formation": r"(?i)\b(?:formation|group|member)\s*[:\-]?\s*([A-Z][\w -]{1,50})",
    "seam": r"(?i)\bseam\s*(?:name|no\.?|identifier)?\s*[:#\-]?\s*([A-Z0-9][\w./-]{0,30})",
    "mineral_resource": r"(?i)\b(?:mineral|resource|reserve)\s*(?:type|name)?\s*[:\-]?\s*([A-Z][\w -]{1,50})",
}
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNIT = r"million\s+tonnes?|kilotonnes?|tonnes?|tons?|Mtpa|Mt|kt|ha|hectares?|km|m2|sqm|square\s+met(?:re|er)s?|met(?:re|er)s?|%|percent(?:age)?|degrees?|deg|°|[A-Za-z][A-Za-z0-9/%².-]*"
QUANTITY = rf"(?i)(?<![\w.])({NUMBER})\s*({UNIT})?"
DATE = r"\b((?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/ ](?:\d{1,2}|[A-Za-z]{3,9})[-/ ,]\d{2,4}))\b"
PAIR = r"(?<![\w/])([+-]?\d+(?:\.\d+)?)\s*[,;/]\s*([+-]?\d+(?:\.\d+)?)(?![\w/])"
DMS = r"(?i)(\d{1,3})\s*°\s*(\d{1,2})\s*[′']\s*(\d{1,2}(?:\.\d+)?)?\s*[″\"]?\s*([NSEW])?"
DM = r"(?i)(\d{1,3})\s*°\s*(\d{1,2}(?:\.\d+)?)\s*[′']\s*([NSEW])?"
LABEL = r"(?i)\b(?:production|output|dispatch|achievement|reserve|resource|depth|thickness|elevation|area|distance|grade|quality|calorific\s+value|ash|moisture|sulphur|sulfur|latitude|longitude|coordinate|tonnage|quantity|target|overburden)\b"
PRODUCTION_PREFIX = r"(?i)(?:production|output|dispatch|achievement)\D*$"
NONNEGATIVE_PREFIX = r"(?i)(?:production|output|dispatch|depth|thickness|area|distance|reserve|resource)\D*$"
NON_UNITS = ("and", "or", "is", "are", "was", "were", "of", "in", "on", "at", "to", "from", "for", "with", "by", "as", "the", "a", "an", "per", "than", "more", "less")
YEAR = r"(?<!\d)(?:18\d{2}|19\d{2}|20\d{2}|21\d{2}|2200)(?!\d)"
PERIOD = r"(?<!\d)(?:18\d{2}|19\d{2}|20\d{2}|21\d{2}|2200)(?:[-/](?:\d{2}|18\d{2}|19\d{2}|20\d{2}|21\d{2}|2200))?(?!\d)"
UNIT_DEFINITION = r"(?i)\bMT\b[\s:;=–—-]{1,32}Million\s+Tonnes\b"


#: Hits that a task gathers before it passes rows on.
HELD = 100_000
_HIT = ArrayType(StructType([StructField("raw", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@cache
def _edge() -> str:
    """The boundary of a word where letters, digits and accents of any script belong to words."""
    every = list(map(chr, range(0x80, 0x110000)))
    numbers = "".join(c for c in every if c.isalnum() and unicodedata.category(c) in ("No", "Nl"))
    marks = "".join(c for c in every if unicodedata.category(c) == "Mn")
    before, after = rf"(?u:(?<=[\w{marks}])(?<![{numbers}]))", rf"(?u:(?=[\w{marks}])(?![{numbers}]))"
    return rf"(?:{before}(?!{after})|(?!{before}){after})"


@cache
def _search(pattern: str, plain: bool) -> Callable[[str], Iterator[re.Match]]:
    """The search of a pattern in ASCII texts, or in others: as in column expressions, ``\\w``, ``\\d`` and case are ASCII's, ``\\b`` is not."""
    return re.compile(pattern if plain else pattern.replace(r"\b", _edge()), re.ASCII).finditer


def found(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """A column ``array<struct<raw, start, end>>`` of all matches for each pattern; places count characters from 0.

    All patterns go over a text in one task: as column expressions, lambdas over gaps, they were evaluated again wherever
    a span was looked at.
    """
    own, at = df.columns, df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row = batch.column(at).to_pylist(), 0
            while row < len(texts):
                first, n = row, 0
                offsets, hits = [[0] for _ in patterns], [([], [], []) for _ in patterns]
                while row < len(texts) and n < HELD:
                    t = texts[row] or ""
                    plain = t.isascii()
                    for pattern, ends, (raw, start, end) in zip(patterns.values(), offsets, hits, strict=True):
                        for m in _search(pattern, plain)(t):
                            raw.append(m.group())
                            start.append(m.start())
                            end.append(m.end())
                        n += len(raw) - ends[-1]
                        ends.append(len(raw))
                    row += 1
                spans = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(raw, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["raw", "start", "end"])) for ends, (raw, start, end) in zip(offsets, hits, strict=True)]
                part = batch.slice(first, row - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *spans], names=[*own, *patterns])

    return df.mapInArrow(work, StructType([*df.schema, *[StructField(name, _HIT) for name in patterns]]))


def _spread(df: DataFrame, spans: Column) -> DataFrame:
    """A row for each span."""
    return df.withColumn("_m", F.explode(spans)).withColumns({"raw_text": F.col("_m.raw"), "start": F.col("_m.start"), "end": F.col("_m.end")}).drop("_m")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _candidate(df: DataFrame, kind: Column | str, raw_value: Column, normalized: Column, numeric: Column | None = None, unit: Column | None = None, failed: Column | None = None, rule: Column | str = "") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    message = F.array(F.struct(lit(rule).alias("rule"), F.lit("FAILED").alias("status")))
    return df.select(
        "unit_id", lit(kind).alias("candidate_type"), "raw_text", raw_value.alias("raw_value"), normalized.alias("normalized_value"),
        (F.lit(None) if numeric is None else numeric).cast("decimal(38,12)").alias("numeric"), (F.lit(None) if unit is None else unit).cast("string").alias("unit"), "start", "end",
        F.when(F.lit(False) if failed is None else failed, message).otherwise(F.array().cast("array<struct<rule:string,status:string>>")).alias("validation"),
    )


def extract_entities(df: DataFrame) -> DataFrame:
    """Names after their labels, by eight rules, in one pass over the texts."""
    def named(kind: str, pattern: str) -> Column:
        value = lambda raw: F.regexp_replace(F.regexp_extract(raw, pattern, 1), r"^[ .,:;-]+|[ .,:;-]+$", "")
        return F.transform(f"_{kind}", lambda m: F.struct(F.lit(kind).alias("kind"), m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"), value(m["raw"]).alias("value")))

    spans = found(df.select("unit_id", "text"), {f"_{kind}": pattern for kind, pattern in ENTITY_RULES.items()})
    rows = spans.select("unit_id", F.explode(F.concat(*[named(*rule) for rule in ENTITY_RULES.items()])).alias("_m"))
    rows = rows.select("unit_id", F.col("_m.raw").alias("raw_text"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end"), F.col("_m.kind").alias("_kind"), F.col("_m.value").alias("_value"))
    return _candidate(rows, F.col("_kind"), F.col("_value"), F.col("_value"))


def parse_date(raw: Column) -> Column:
    """ISO dates and five other formats as ISO text; null for what is no date."""
    iso = F.regexp_replace(raw, "/", "-")
    tries = [F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso), F.lit("yyyy-MM-dd"))]
    for shape, fmt in ((r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy")):
        tries.append(F.try_to_timestamp(F.when(raw.rlike(shape), F.initcap(raw)), F.lit(fmt)))
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def extract_dates(df: DataFrame) -> DataFrame:
    rows = _spread(found(df.select("unit_id", "text"), {"_dates": DATE}), F.col("_dates")).withColumn("_value", parse_date(F.col("raw_text")))
    return _candidate(rows, "date_time", F.col("raw_text"), F.col("_value"), failed=F.col("_value").isNull(), rule="date_value")


def _degrees(match: Column, pattern: str, seconds: bool) -> Column:
    g = lambda i: F.regexp_extract(match, pattern, i)
    sec = F.coalesce(F.nullif(g(3), F.lit("")).try_cast("double"), F.lit(0.0)) if seconds else F.lit(0.0)
    minute = g(2).try_cast("double")
    value = g(1).try_cast("double") + minute / 60 + sec / 3600
    hem = F.upper(g(4 if seconds else 3))
    return F.struct(F.when((minute < 60) & (sec < 60), F.when(hem.isin("S", "W"), -value).otherwise(value)).alias("v"), hem.alias("h"))


def parse_pair(raw: Column) -> Column:
    """``struct(lon, lat)``: two values in degrees, minutes and seconds, or degrees and minutes, or a decimal pair; null if none is valid.

    Hemispheres tell the order; without them longitude comes first, unless only the second value can be one.
    """
    def two(pattern: str, seconds: bool, otherwise: Column) -> Column:
        def placed(a: Column, b: Column) -> Column:
            swap = a["h"].isin("N", "S") & b["h"].isin("E", "W")
            lon, lat = F.when(swap, b["v"]).otherwise(a["v"]), F.when(swap, a["v"]).otherwise(b["v"])
            return F.when((F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.struct(lon.alias("lon"), lat.alias("lat")))

        degrees = lambda all_, i: _degrees(F.get(all_, F.lit(i)), pattern, seconds)
        both = lambda all_: _once(degrees(all_, 0), lambda a: _once(degrees(all_, 1), lambda b: placed(a, b)))
        return _once(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), lambda all_: F.when(F.size(all_) >= 2, both(all_)).otherwise(otherwise))

    def decimal(a: Column, b: Column) -> Column:
        swap = (F.abs(a) <= 90) & (F.abs(b) <= 180) & (F.abs(b) > 90)
        return F.when(swap, F.struct(b.alias("lon"), a.alias("lat"))).when((F.abs(a) <= 180) & (F.abs(b) <= 90), F.struct(a.alias("lon"), b.alias("lat")))

    number = lambda i: F.nullif(F.regexp_extract(raw, PAIR, i), F.lit("")).try_cast("double")
    return two(DMS, True, two(DM, False, _once(number(1), lambda a: _once(number(2), lambda b: decimal(a, b)))))


def _overlaps(spans: Column | str, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def _pair_text(pair: Column) -> Column:
    return F.when(pair.isNotNull(), F.concat_ws(",", pair["lon"].cast("string"), pair["lat"].cast("string")))


def _with_spans(df: DataFrame, **more: str) -> DataFrame:
    """Spans of dates, of quantities, and of decimal pairs outside dates and quantities with units."""
    spans = found(df.select("unit_id", "text"), {"_dates": DATE, "_quantities": QUANTITY, "_pairs": PAIR, **more})
    units = F.filter("_quantities", lambda m: F.regexp_extract(m["raw"], QUANTITY, 2) != "")
    free = lambda units: F.filter("_pairs", lambda m: ~_overlaps("_dates", m["start"], m["end"]) & ~_overlaps(units, m["start"], m["end"]))
    return spans.withColumn("_coords", _once(units, free))


def extract_coordinates(df: DataFrame) -> DataFrame:
    """Decimal pairs outside dates and quantities with units, and the first two values in degrees and minutes."""
    spans = _with_spans(df, _marks=DMS)
    start, end = F.element_at("_marks", 1)["start"], F.element_at("_marks", 2)["end"]
    both = F.struct(F.substring(F.col("text"), start + 1, end - start).alias("raw"), start.alias("start"), end.alias("end"))
    rows = _spread(spans, F.concat("_coords", F.when(F.size("_marks") >= 2, F.array(both)).otherwise(F.array().cast(_HIT))))
    rows = rows.select("unit_id", "raw_text", "start", "end", parse_pair(F.col("raw_text")).alias("_pair"))
    return _candidate(rows, "coordinate", F.col("raw_text"), _pair_text(F.col("_pair")), failed=F.col("_pair").isNull(), rule="coordinate_range")


def extract_quantities(df: DataFrame) -> DataFrame:
    """Numbers with units, and labelled numbers without; production or measurement by the 70 characters before them.

    Numbers in dates and coordinates are left out. A number with an unknown unit is kept only after a label, and not where
    the unit is a function word.
    """
    rows = _spread(_with_spans(df), F.filter("_quantities", lambda m: ~_overlaps("_dates", m["start"], m["end"]) & ~_overlaps("_coords", m["start"], m["end"])))
    rows = rows.withColumns({
        "_prefix": F.substring(F.col("text"), F.greatest(F.lit(1), F.col("start") - 69), F.least(F.lit(70), F.col("start"))),
        "_value": F.regexp_extract("raw_text", QUANTITY, 1), "_raw_unit": F.nullif(F.regexp_extract("raw_text", QUANTITY, 2), F.lit("")),
    })
    rows = normalize_units(rows.withColumn("_number", F.regexp_replace("_value", ",", "")), "_number", "_raw_unit", EXTRACTION_UNITS)
    known = F.col("normalized_value").isNotNull()
    labelled = F.when(F.col("start") > 0, F.col("_prefix").rlike(LABEL)).otherwise(False)
    word = F.lower(F.trim(F.coalesce("_raw_unit", F.lit("")))).isin(*NON_UNITS)
    rows = rows.where(F.when(F.col("_raw_unit").isNull(), labelled).when(~known, labelled & ~word).otherwise(True))
    number = F.col("_number").try_cast("decimal(38,12)")
    prefix = F.when(F.col("start") > 0, F.col("_prefix")).otherwise("")
    kind = F.when(prefix.rlike(PRODUCTION_PREFIX), "production_record").otherwise("measurement")
    rows = rows.where(number.isNotNull()).withColumn("raw_text", F.trim("raw_text"))
    text_value = F.when(known, F.col("normalized_value").cast("double").cast("string")).otherwise(F.col("_number"))
    return _candidate(rows, kind, F.col("_value"), text_value, F.col("normalized_value"), F.col("normalized_unit"), (number < 0) & prefix.rlike(NONNEGATIVE_PREFIX), "nonnegative_domain_value")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate for each type and span of a unit."""
    w = Window.partitionBy("unit_id", "candidate_type", "start", "end").orderBy("raw_text")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extract_candidates(df: DataFrame) -> DataFrame:
    """All candidates of ``df (unit_id, text)``."""
    return dedup_candidates(extract_entities(df).unionByName(extract_dates(df)).unionByName(extract_quantities(df)).unionByName(extract_coordinates(df)))


def candidate_ids(candidates: DataFrame, version: str = "document_version_id") -> DataFrame:
    """A deterministic id from version, unit, type and span."""
    return candidates.withColumn("id", uuid5(F.lit(NAMESPACE), F.concat_ws("|", version, "unit_id", "candidate_type", "start", "end")))


def prior_match(candidates: DataFrame) -> DataFrame:
    """``match_status`` against earlier names of the type in the version ``(document_version_id, seq, candidate_type, raw_value)``: equal, one the beginning of the other, or neither."""
    rows = candidates.withColumn("_key", mention_key(F.coalesce("raw_value", F.lit(""))))
    group = ["document_version_id", "candidate_type"]
    # a key is known from its first mention on; a key and its beginnings meet by equality, so no mention carries all earlier ones
    first = rows.groupBy(*group, "_key").agg(F.min("seq").alias("_first"))
    whole = first.where("_key <> ''").select(*group, F.col("_key").alias("_part"), F.col("_first").alias("_whole"))
    parts = first.withColumn("_part", F.explode(F.when(F.col("_key") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.substring(F.col("_key"), F.lit(1), n)))))
    # the earliest key that begins this one, and the earliest that this one begins
    begins = parts.join(whole, [*group, "_part"]).groupBy(*group, "_key").agg(F.min(F.when(F.col("_part") != F.col("_key"), F.col("_whole"))).alias("_shorter"))
    begun = parts.where("_key <> ''").groupBy(*group, F.col("_part").alias("_k")).agg(F.min(F.when(F.col("_part") != F.col("_key"), F.col("_first"))).alias("_longer"))
    any_ = first.where("_key <> ''").groupBy(*group).agg(F.min("_first").alias("_any"))
    known = first.join(begins, [*group, "_key"], "left").join(begun.withColumnRenamed("_k", "_key"), [*group, "_key"], "left").join(any_, group, "left")
    known = known.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_key").alias("_known"), "_first", F.least("_shorter", F.when(F.col("_key") == "", F.col("_any")).otherwise(F.col("_longer"))).alias("_near"))
    joined = rows.join(known, F.col("_key").eqNullSafe(F.col("_known")) & F.col("document_version_id").eqNullSafe(F.col("_document_version_id")) & F.col("candidate_type").eqNullSafe(F.col("_candidate_type")), "left")
    status = F.when(F.col("_first") < F.col("seq"), "MATCHED").when(F.col("_near") < F.col("seq"), "POSSIBLE_MATCH").otherwise("UNRESOLVED")
    return joined.withColumn("match_status", status).drop("_key", "_known", "_first", "_near", *[f"_{c}" for c in group])


def extraction_summary(candidates: DataFrame) -> DataFrame:
    failed = F.exists("validation", lambda v: v["status"] == "FAILED")
    return candidates.groupBy("candidate_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("normalized_value").isNull(), 1)).alias("unresolved"), F.count(F.when(failed, 1)).alias("failures"))


def header_key(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), "[^a-z0-9]+", "")


def _header(value: Column) -> Column:
    """``value`` of the cell's column in the first row, ``_head``; a window, as the cells are dealt by table already and a join could broadcast all headers."""
    return F.max(F.when(F.col("row_index") == F.col("_head"), value)).over(Window.partitionBy("table_id", "column_index"))


def table_rows(cells: DataFrame) -> DataFrame:
    """``(table_id, row_index, values, cells)``: each row after the first as a map from header to value; a blank header is the column's number.

    ``cells`` keeps each cell with its header and, where ``cells`` has a column ``id``, its ``cell_id``.
    """
    rows = cells.withColumn("_head", F.min("row_index").over(Window.partitionBy("table_id")))
    body = rows.withColumn("_h", _header(F.nullif(F.trim("raw_value"), F.lit("")))).where("row_index > _head")
    cell_id = (F.col("id") if "id" in cells.columns else F.lit(None)).cast("string").alias("cell_id")
    entry = F.struct(F.col("column_index"), F.coalesce("_h", F.col("column_index").cast("string")).alias("header"), F.col("raw_value"), cell_id)
    grouped = body.groupBy("table_id", "row_index").agg(F.sort_array(F.collect_list(entry)).alias("cells"))
    last = F.aggregate("cells", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["header"]), F.map_from_arrays(F.array(c["header"]), F.array(c["raw_value"]))))
    return grouped.select("table_id", "row_index", last.alias("values"), "cells")


#: Fixed values of the table rules.
SPATIAL_TYPES = ("BOREHOLE", "VERIFIED_COORDINATE", "COORDINATE", "MINE")


#: Headers that become metadata, and under which name.
SPATIAL_METADATA = {"state": "state", "district": "district", "mine": "mine", "description": "description", "elevationm": "elevation", "elevation": "elevation", "depthm": "depth", "depth": "depth", "coordinatesystem": "coordinate_system", "crs": "coordinate_system"}
NAME_HEADERS = ("name", "entityname", "boreholename")


def spatial_rows(rows: DataFrame) -> DataFrame:
    """Candidates of rows that name a type, a name and, when complete, a latitude and a longitude under their headers.

    ``metadata`` holds what else the row says and where it stands, ``validation`` what was checked, ``source_cells`` the
    cell of each header and ``source_cell_id`` the cell of the name. Explicit latitude and longitude are geographic degrees
    unless the row declares another system. An incomplete or invalid coordinate stays a candidate, with a FAILED check.
    """
    entry = F.transform(F.map_entries("values"), lambda e: F.struct(header_key(e["key"]).alias("k"), e["value"].alias("v")))

    def under(key: str) -> Column:
        return F.get(F.filter(entry, lambda e: e["k"] == key), F.lit(0))["v"]

    def got(*keys: str) -> Column:
        return F.coalesce(*map(under, keys))

    out = rows.withColumns({"_type": F.upper(F.trim(F.coalesce(got("entitytype", "recordtype", "type"), F.lit("")))), "_name": F.trim(F.coalesce(got(*NAME_HEADERS), F.lit(""))), "_lat": F.trim(got("latitude", "lat")), "_lon": F.trim(got("longitude", "lon", "long"))})
    out = out.where(F.col("_type").isin(*SPATIAL_TYPES) & (F.col("_name") != ""))
    lat, lon = F.col("_lat").try_cast("decimal(38,12)"), F.col("_lon").try_cast("decimal(38,12)")
    complete = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    numeric = lat.isNotNull() & lon.isNotNull()
    fine = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    point = F.col("_type").isin("VERIFIED_COORDINATE", "COORDINATE")
    status = F.when(complete & fine, "PASSED").when(complete | point, "FAILED").otherwise("WARNING")
    value = F.when(point, F.concat(F.coalesce("_lon", F.lit("")), F.lit(","), F.coalesce("_lat", F.lit("")))).otherwise(F.col("_name"))
    kind = F.when(point, "coordinate").when(F.col("_type") == "BOREHOLE", "borehole").otherwise("mine")
    check = lambda s, message: F.struct(F.lit("coordinate_range").alias("rule"), F.lit(s).alias("status"), F.lit(message).alias("message"))
    first = (
        F.when(~complete, check("WARNING", "no pair of coordinates")).when(~numeric, check("FAILED", "a coordinate is not a number"))
        .when(fine, check("PASSED", "both coordinates are in range")).otherwise(check("FAILED", "a coordinate is out of range"))
    )
    checks = F.when(~complete & point, F.array(first, check("FAILED", "a coordinate row needs a pair of coordinates"))).otherwise(F.array(first))
    names: dict[str, list[str]] = {}
    for key, name in SPATIAL_METADATA.items():
        names.setdefault(name, []).insert(0, key)
    said = {name: got(*keys) for name, keys in names.items()}
    said["coordinate_system"] = F.coalesce(F.nullif(said["coordinate_system"], F.lit("")), F.when(complete & numeric, F.lit("EPSG:4326")))
    said |= {"latitude": F.when(complete & numeric, F.col("_lat")), "longitude": F.when(complete & numeric, F.col("_lon")), "rule": F.lit("labeled_spatial_table_row"), "display_name": F.col("_name"), "spatial_entity_type": F.col("_type"), "table_row_index": F.col("row_index").cast("string"), "source_table_id": F.col("table_id").cast("string")}
    metadata = F.map_filter(F.create_map(*[x for name, v in said.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())
    name_cell = F.filter("cells", lambda c: F.when(point, header_key(c["header"]).isin(*NAME_HEADERS)).otherwise(F.trim(F.coalesce(c["raw_value"], F.lit(""))) == F.col("_name")))
    return out.select(
        "table_id", "row_index", kind.alias("candidate_type"), value.alias("raw_value"), F.col("_name").alias("display_name"), status.alias("coordinate_status"),
        F.when(status == "PASSED", F.col("_lat")).alias("latitude"), F.when(status == "PASSED", F.col("_lon")).alias("longitude"), metadata.alias("metadata"), checks.alias("validation"),
        F.transform("cells", lambda c: F.struct(c["header"].alias("header"), c["cell_id"].alias("cell_id"))).alias("source_cells"), F.get(name_cell, F.lit(0))["cell_id"].alias("source_cell_id"),
    )


# Fixed values of the production tables' rules.
MEASURE = r"(?i)production|output|dispatch|achievement|quantity|tonnage"
EXCLUDED = r"(?i)%|percent|share|growth|change|rate|average|difference|index"
MASS = r"(?i)\b(million\s+tonnes?|kilotonnes?|tonnes?|tons?|Mt|kt)\b"
HEADING_KEYS = ("year", "years", "period", "reportingperiod", "reportingyear", "financialyear", "country", "countries", "countrygroup", "state", "states", "sector", "company", "commodity", "mineral", "production", "unit", "quantity")
PERIOD_KEYS = ("period", "reportingperiod", "reportingyear", "financialyear", "year")
AMOUNT = rf"^\s*({NUMBER})\s*([A-Za-z%²]+)?\s*$"


def unit_definitions(pages: DataFrame) -> DataFrame:
    """``(document_version_id, definition_page)``: the first page that says that MT is million tonnes."""
    return pages.where(F.col("text").rlike(UNIT_DEFINITION)).groupBy("document_version_id").agg(F.min("page_id").alias("definition_page"))


def production_rows(cells: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Production amounts of tables ``(table_id, row_index, column_index, raw_value)``; ``definitions (table_id)`` are tables whose document defines MT.

    Where ``cells`` has a column ``id``, ``source_cell_id`` and ``source_cells`` say where an amount stands; ``definitions``
    may have ``definition`` and ``definition_page``, which are kept with the amounts that need them.

    The first row is the title. Rows before the first amount are headings, joined column by column. A table without measure
    word or mass unit, a column of shares or changes, and an amount without a year are left out.
    """
    value = F.trim(F.coalesce("raw_value", F.lit("")))
    known = F.lit(False) if definitions is None else F.col("_d").isNotNull()
    rows = cells.withColumn("v", value).withColumn("_head", F.min("row_index").over(Window.partitionBy("table_id")))
    text = rows.groupBy(F.col("table_id").alias("_t")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("row_index") == F.col("_head")) & (F.col("v") != ""), F.struct("column_index", "v")))), lambda x: x["v"]), " ").alias("title"),
        F.min_by(F.when(F.col("row_index") > F.col("_head"), F.nullif(F.regexp_extract("v", MASS, 1), F.lit(""))), F.when((F.col("row_index") > F.col("_head")) & F.col("v").rlike(MASS), F.struct("row_index", "column_index"))).alias("body_unit"),
    ).where(F.col("title").rlike(MEASURE))
    if definitions is not None:
        said = [c for c in ("definition", "definition_page") if c in definitions.columns]
        text = text.hint("merge").join(definitions.groupBy(F.col("table_id").alias("_d")).agg(F.count(F.lit(1)).alias("_defined"), *[F.min(c).alias(c) for c in said]), F.col("_t") == F.col("_d"), "left")
    unit = F.coalesce(F.nullif(F.regexp_extract("title", MASS, 1), F.lit("")), "body_unit")
    settled = lambda u: F.when((F.lower(u) == "mt") & (u != "Mt") & known, "Mt").otherwise(u)
    text = text.withColumns({"raw_unit": unit, "unit": settled(unit), "defined": known, "one": F.lit("1")})
    text = normalize_units(text, "one", "unit", EXTRACTION_UNITS).where("dimension = 'mass'")
    text = text.select("_t", "title", "raw_unit", F.col("normalized_value").alias("table_factor"), "defined", *[(F.col(c) if c in text.columns else F.lit(None)).cast("string").alias(c) for c in ("definition", "definition_page")])
    # a row for each table, and no broadcast of them all; the rest are windows over cells dealt by table
    body = rows.join(text.hint("merge"), F.col("table_id") == F.col("_t")).withColumn("_top", F.col("row_index") == F.col("_head"))
    amount = F.col("v").rlike(AMOUNT)
    label = F.max(F.when(F.col("column_index") == 0, F.col("v"))).over(Window.partitionBy("table_id", "row_index"))
    body = body.withColumn("row_label", F.coalesce(label, F.lit("")))
    data = (F.col("row_label") != "") & ~F.regexp_replace(F.lower("row_label"), "[^a-z]+", "").isin(*HEADING_KEYS) & (F.col("column_index") > 0) & amount & ~F.col("_top")
    body = body.withColumn("_start", F.min(F.when(data, F.col("row_index"))).over(Window.partitionBy("table_id"))).where(F.col("_start").isNotNull())
    stacked = F.col("_top") | ((F.col("row_index") < F.col("_start")) & ~F.col("v").rlike(r"^\(\s*\d+\s*\)$"))
    label_parts = F.collect_list(F.when((F.col("v") != "") & stacked, F.struct("row_index", "v"))).over(Window.partitionBy("table_id", "column_index"))
    body = body.withColumns({"_parts": label_parts, "head_key": header_key(_header(F.nullif("v", F.lit(""))))}).where(~F.col("_top"))
    body = body.withColumn("parts", F.array_distinct(F.transform(F.sort_array("_parts"), lambda x: x["v"]))).drop("_parts")
    own = F.max(F.when(F.col("head_key").isin(*PERIOD_KEYS) & F.col("v").rlike(YEAR), F.col("v"))).over(Window.partitionBy("table_id", "row_index"))
    column = F.array_join("parts", " ")
    none = lambda c: F.nullif(c, F.lit(""))
    period = F.coalesce(own, F.when(F.col("row_label").rlike(f"^{YEAR}$"), F.col("row_label")), none(F.regexp_extract(column, PERIOD, 0)), none(F.regexp_extract("title", PERIOD, 0)))
    cell_id = (F.col("id") if "id" in cells.columns else F.lit(None)).cast("string")
    body = body.withColumns({"column_label": column, "period": period, "source_cell_id": cell_id})
    each = F.struct("column_index", F.coalesce(none(F.col("column_label")), F.col("column_index").cast("string")).alias("label"), F.col("source_cell_id").alias("cell_id"))
    body = body.withColumn("source_cells", F.sort_array(F.collect_list(each).over(Window.partitionBy("table_id", "row_index"))))
    out = body.where((F.col("row_index") >= F.col("_start")) & (F.col("column_index") > 0) & amount & ~F.col("column_label").rlike(EXCLUDED) & F.col("period").rlike(YEAR))
    cell_unit = none(F.regexp_extract("v", AMOUNT, 2))
    out = out.withColumns({"raw_value": F.regexp_extract("v", AMOUNT, 1), "cell_unit": cell_unit, "_one": F.lit("1")})
    out = out.withColumn("_cu", F.when((F.lower("cell_unit") == "mt") & (F.col("cell_unit") != "Mt") & F.col("defined"), "Mt").otherwise(F.col("cell_unit")))
    out = normalize_units(out, "_one", "_cu", EXTRACTION_UNITS)
    factor = F.when(F.col("cell_unit").isNull(), F.col("table_factor")).when(F.col("dimension") == "mass", F.col("normalized_value"))
    readable = F.filter("parts", lambda p: ~(p.rlike(MEASURE) & ((F.length(p) > 32) | p.rlike(PERIOD))))
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(none(F.array_join(readable, " ")), "column_label"), MASS, ""), r"\s+", " "), r"^[ \-:|\n]+|[ \-:|\n]+$", "")
    named = F.coalesce(none(named), F.lit("production"))
    plain = (F.col("row_label") == "") | F.lower("row_label").isin("india", "all india", "world", "total")
    number = F.regexp_replace("raw_value", ",", "").try_cast("decimal(20,6)")
    out = out.withColumn("normalized", (number * factor).cast("decimal(29,6)")).where(F.col("normalized").isNotNull())
    return out.select("table_id", "row_index", "column_index", "raw_value", F.col("normalized").alias("normalized_value"), F.lit("t").alias("unit"), "period", F.when(plain, named).otherwise(F.concat("row_label", F.lit(" — "), named)).alias("commodity"), F.when(number < 0, "FAILED").otherwise("PASSED").alias("nonnegative"), F.coalesce("cell_unit", "raw_unit").alias("source_unit"), F.col("title").alias("source_table_title"), F.col("row_label").alias("source_row_label"), "source_cell_id", "source_cells", "definition", "definition_page")


#: Fixed value: headers that say what a cell is.
RELEVANT_HEADER = r"(?i)mine|project|block|borehole|seam|formation|mineral|reserve|production|output|depth|thickness|elevation|coordinate|latitude|longitude|grade|quality|date|period"


def cell_context(cells: DataFrame) -> DataFrame:
    """``context``: a cell's text with its header before it, where the header says what the cell is."""
    rows = cells.withColumn("_head", F.min("row_index").over(Window.partitionBy("table_id")))
    joined = rows.withColumn("header", _header(F.trim("raw_value")))
    fits = (F.col("row_index") > F.col("_head")) & F.col("header").rlike(RELEVANT_HEADER)
    return joined.withColumn("context", F.when(fits, F.concat_ws(": ", "header", "raw_value")).otherwise(F.coalesce("raw_value", F.lit("")))).drop("_head", "header")


def source_units(pages: DataFrame, contents: DataFrame, cells: DataFrame, used_cells: DataFrame | None = None) -> DataFrame:
    """``(page_id, unit_id, text)``: contents and cells; a page's own text only where it has neither; cells of row candidates are left out."""
    own = contents.select("page_id", F.concat(F.lit("content:"), "id").alias("unit_id"), "text")
    each = cells if used_cells is None else cells.join(used_cells.select(F.col("cell_id").alias("_u")), F.col("cell_id") == F.col("_u"), "left_anti")
    cell = each.select("page_id", F.concat(F.lit("cell:"), "cell_id").alias("unit_id"), "text")
    have = contents.select("page_id").unionByName(cells.select("page_id")).distinct()
    bare = pages.join(have, "page_id", "left_anti").where(F.col("text").isNotNull()).select("page_id", F.concat(F.lit("page:"), "page_id").alias("unit_id"), "text")
    return own.unionByName(cell).unionByName(bare)
