"""Classification, validation, matching, conflicts and review decisions on candidates."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import case_fold, entity_key, name_key
from ..functions.units import EXTRACTION_UNITS, normalize_units
from ..streaming.tables import shared
from .extract import YEAR

# What candidates are, and the words that tell.
TYPES = {"mine": "MINE", "project": "PROJECT", "coal_block": "COAL_BLOCK", "borehole": "BOREHOLE", "seam": "SEAM", "geological_formation": "GEOLOGICAL_FORMATION", "exploration_location": "EXPLORATION_LOCATION", "mineral_resource": "RESOURCE", "production_record": "PRODUCTION", "coordinate": "COORDINATE"}
ENTITIES = ("MINE", "PROJECT", "COAL_BLOCK", "BOREHOLE", "SEAM", "GEOLOGICAL_FORMATION", "EXPLORATION_LOCATION", "RESOURCE")
FUZZY = 0.88
WAYS = 1000  # most texts that are left of a short name when letters are cut
DEPTH_WORDS = r"(?i)depth|thickness|elevation|grade|quality|ash|moisture|sulphur|sulfur"
SHARE_WORDS = r"(?i)share|growth|percent(?:age)?|increase|decrease|change|variation|rate"


def _failed(validations: Column) -> Column:
    return F.coalesce(F.exists(validations, lambda v: v["status"] == "FAILED"), F.lit(False))


def has_validation(validations: Column, status: str) -> Column:
    return F.coalesce(F.exists(validations, lambda v: v["status"] == status), F.lit(False))


def _dimension(cands: DataFrame) -> DataFrame:
    """``_dimension`` of the unit in the extraction registry; null for none."""
    out = normalize_units(cands.withColumnRenamed("normalized_value", "_own").withColumn("_one", F.lit("1")), "_one", "unit", EXTRACTION_UNITS)
    return out.withColumnRenamed("dimension", "_dimension").drop("_one", "normalized_value", "normalized_unit", "conversion_rule", "unit_issue").withColumnRenamed("_own", "normalized_value")


def classify(cands: DataFrame) -> DataFrame:
    """``classification``, ``confidence`` and ``rule`` of candidates ``(candidate_type, raw_text, raw_value, normalized_value, normalized_numeric_value, unit, metadata, validation_results)``.

    Later rules override earlier ones: by type; measurements by their words and unit; production by its fields; no value;
    a failed coordinate.
    """
    rows = _dimension(cands)
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    by_type = F.element_at(kinds, F.col("candidate_type"))
    meta = lambda k: F.coalesce(F.element_at("metadata", k), F.lit(""))
    words = F.concat_ws(" ", meta("table_header"), meta("measurement_type"), F.coalesce("raw_text", F.lit("")))
    complete = F.col("normalized_numeric_value").isNotNull() & F.col("normalized_value").isNotNull() & F.coalesce(F.col("_dimension") == "mass", F.lit(False)) & meta("reporting_period").rlike(YEAR) & ~_failed(F.col("validation_results"))
    is_measure, is_production = F.col("candidate_type") == "measurement", F.col("candidate_type") == "production_record"
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    pick = lambda c, v, r: F.struct(F.lit(c).alias("c"), F.lit(v).cast("double").alias("v"), F.lit(r).alias("r"))
    result = (
        F.when((F.col("candidate_type") == "coordinate") & _failed(F.col("validation_results")), pick("UNKNOWN", None, "coordinate_validation_failed"))
        .when(empty("raw_value") & empty("normalized_value"), pick("UNKNOWN", None, "candidate_value_missing"))
        .when(is_production & complete, pick("PRODUCTION", 0.97, "verified_production_fields_present"))
        .when(is_production, pick("PRODUCTION", 0.85, "production_fallback"))
        .when(is_measure & words.rlike(DEPTH_WORDS), pick("GEOLOGICAL_MEASUREMENT", 0.92, "measurement_header_label"))
        .when(is_measure & F.coalesce(F.col("_dimension") == "percentage", F.lit(False)) & words.rlike(SHARE_WORDS), pick("MEASUREMENT", 0.92, "percentage_source_semantics"))
        .when(is_measure, pick("MEASUREMENT", 0.85, "measurement_source_value"))
        .when(by_type.isNotNull(), F.struct(by_type.alias("c"), F.lit(0.97).alias("v"), F.concat(F.lit("candidate_type:"), "candidate_type").alias("r")))
        .otherwise(pick("UNKNOWN", None, "no_deterministic_rule"))
    )
    out = rows.withColumn("_p", result)
    return out.withColumns({"classification": F.col("_p.c"), "confidence": F.col("_p.v"), "rule": F.col("_p.r")}).drop("_p", "_dimension")


OWNED_RULES = ("production_nonnegative", "production_fields", "measurement_value_unit", "coordinate_range")


def refresh_validation(cands: DataFrame) -> DataFrame:
    """``validation_results`` with the four rules of this job computed anew and all others kept."""
    rows = _dimension(cands)
    n = F.col("normalized_numeric_value").cast("double")
    finite = F.coalesce(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    status = lambda ok, rule: F.array(F.struct(F.lit(rule).alias("rule"), F.when(F.coalesce(ok, F.lit(False)), "PASSED").otherwise("FAILED").alias("status")))
    mass = F.coalesce(F.col("_dimension") == "mass", F.lit(False))
    fields = finite & (n >= 0) & mass & F.col("normalized_value").isNotNull() & F.coalesce(F.element_at("metadata", "reporting_period"), F.lit("")).rlike(YEAR)
    lon, lat = (F.element_at("metadata", k).try_cast("double") for k in ("longitude", "latitude"))
    kind = F.col("candidate_type")
    new = (
        F.when(kind == "production_record", F.concat(status(finite & (n >= 0), "production_nonnegative"), status(fields, "production_fields")))
        .when(kind == "measurement", status(finite & F.col("_dimension").isNotNull(), "measurement_value_unit"))
        .when(kind == "coordinate", status((F.abs(lon) <= 180) & (F.abs(lat) <= 90), "coordinate_range"))
        .otherwise(F.array().cast("array<struct<rule:string,status:string>>"))
    )
    kept = F.filter(F.coalesce("validation_results", F.array().cast("array<struct<rule:string,status:string>>")), lambda v: ~v["rule"].isin(*OWNED_RULES))
    return rows.withColumn("validation_results", F.concat(kept, new)).drop("_dimension")


def approval_issues(cands: DataFrame) -> DataFrame:
    """``issues`` of classified candidates: what a reviewer should know before approving."""
    lon, lat = (F.element_at("metadata", k).try_cast("double") for k in ("longitude", "latitude"))
    point = F.col("candidate_type") == "coordinate"
    missing = F.element_at("metadata", "longitude").isNull() | F.element_at("metadata", "latitude").isNull()
    return cands.withColumn("issues", F.array_compact(F.array(
        F.when(F.col("classification") == "UNKNOWN", "AMBIGUOUS_CLASSIFICATION").when(F.coalesce("confidence", F.lit(0.0)) < 0.8, "LOW_CONFIDENCE"),
        F.when(F.col("normalized_value").isNull() & F.col("normalized_numeric_value").isNull() & (F.coalesce("raw_value", F.lit("")) == ""), "NO_VALUE"),
        F.when(F.col("verification_status") == "REJECTED", "REJECTED"),
        F.when(F.col("classification").isin("PRODUCTION", "GEOLOGICAL_MEASUREMENT", "MEASUREMENT") & (F.col("normalized_numeric_value").isNull() | (F.coalesce("unit", F.lit("")) == "")), "VALUE_OR_UNIT_MISSING"),
        F.when(_failed(F.col("validation_results")), "FAILED_VALIDATION"),
        F.when(point & missing, "COORDINATE_MISSING").when(point & ~F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.lit(False)), "COORDINATE_OUT_OF_RANGE"),
    )))


EDITABLE = ("raw_text", "raw_value", "normalized_value", "normalized_numeric_value", "unit")


def edit_issues(decisions: DataFrame) -> DataFrame:
    """``edit_issue`` of edits ``(classification, edited map<string,string>)``: unknown fields, no value, no number, no known unit; null if fine or no edit."""
    e = lambda k: F.element_at("edited", k)
    number = e("normalized_numeric_value").try_cast("double")
    rows = normalize_units(decisions.withColumns({"_one": F.lit("1"), "_u": e("unit")}), "_one", "_u", EXTRACTION_UNITS)
    issue = (
        F.when(F.col("edited").isNull(), None)
        .when(F.size(F.array_except(F.map_keys("edited"), F.array(*map(F.lit, EDITABLE)))) > 0, "UNSUPPORTED_FIELDS")
        .when(F.coalesce(e("raw_value"), e("normalized_value"), e("normalized_numeric_value")).isNull(), "NO_VALUE")
        .when(e("normalized_numeric_value").isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))), "NOT_A_NUMBER")
        .when(e("normalized_numeric_value").isNotNull() & F.col("classification").isin("PRODUCTION", "GEOLOGICAL_MEASUREMENT", "MEASUREMENT") & F.col("unit_issue").isNotNull(), "UNIT_UNKNOWN")
    )
    return rows.withColumn("edit_issue", issue).drop("_one", "_u", "normalized_value", "normalized_unit", "dimension", "conversion_rule", "unit_issue")


def similarity(a: pd.Series, b: pd.Series, least: float = 0.0) -> pd.Series:
    """Matching-blocks ratio of two texts, from 0 to 1; where the letters in common alone keep it below ``least``, that bound."""

    def ratio(x: str, y: str) -> float:
        matcher = SequenceMatcher(None, x, y)
        bound = matcher.quick_ratio() if least else 1.0
        return bound if bound < least else matcher.ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _ratio(least: float = 0.0) -> object:
    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return similarity(a, b, least)

    return scored


def _rare(rows: DataFrame, of: list[str], gram: str, key: str, least: float) -> DataFrame:
    """Of each key's runs of letters ``(*of, gram, n)`` the rarest that a partner cannot all lack, by ``n``, then by themselves.

    ``u`` unmatched letters of a key and ``w`` of its partner spoil ``3 u + 2 w`` of its runs at most. With lengths ``a`` and
    ``b`` and the ratio at ``least`` that is ``3 a + 2 b - 2.5 least (a + b)``, most for the shortest partner. All others are
    in common, so the rarest run in common is among that many and one more, for both keys. Keys of up to eight letters keep all runs.
    """
    a = F.length(key)
    shortest = F.ceil(a * F.lit(least / (2 - least)) - F.lit(1e-9))
    most = F.floor(3 * a + 2 * shortest - F.lit(2.5 * least) * (a + shortest) + F.lit(1e-9)) + 1
    w = Window.partitionBy(*of).orderBy("n", gram)
    return rows.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= most) | (a <= 8)).drop("_r", "n")


def candidate_pairs(keys: DataFrame, known: DataFrame, least: float = FUZZY) -> DataFrame:
    """Pairs ``(ct, ck, ek, entity_id)`` of ``keys (ct, ck)`` and ``known (et, ek, entity_id)`` of one type that may reach a ratio of ``least``.

    They share one of their rarest runs, their lengths allow the ratio, and so does the number of edits between them.
    """

    def runs(key: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(key) - n, F.lit(0))), lambda i: F.substring(key, i + 1, F.lit(n)))

    def run(key: Column) -> Column:
        return F.when(F.length(key) <= 5, F.concat(runs(key, 3), runs(key, 2))).otherwise(runs(key, 3))

    c = keys.select("ct", "ck", F.explode(F.array_distinct(run(F.col("ck")))).alias("g"))
    e = known.select("et", "ek", "entity_id", F.explode(F.array_distinct(run(F.col("ek")))).alias("h"))
    often = c.select(F.col("ct").alias("t"), F.col("g").alias("x")).unionByName(e.select(F.col("et").alias("t"), F.col("h").alias("x"))).groupBy("t", "x").agg(F.count(F.lit(1)).alias("n"))
    c = _rare(c.join(often, (F.col("ct") == F.col("t")) & (F.col("g") == F.col("x"))).drop("t", "x"), ["ct", "ck"], "g", "ck", least)
    e = _rare(e.join(often, (F.col("et") == F.col("t")) & (F.col("h") == F.col("x"))).drop("t", "x"), ["et", "ek"], "h", "ek", least)
    a, b = F.length("ck"), F.length("ek")
    band = F.least(a, b) * 2 >= (a + b) * F.lit(least)
    near = F.levenshtein("ck", "ek") <= F.floor((a + b) * F.lit(1 - least) + F.lit(1e-9))  # no more edits than unmatched letters
    return c.join(e, (F.col("ct") == F.col("et")) & (F.col("g") == F.col("h")) & band & near).select("ct", "ck", "ek", "entity_id").distinct()


def _ways(n: Column, k: Column) -> Column:
    """Number of choices of ``k`` letters among ``n``."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(1.0), lambda acc, i: F.when(i == 0, acc).otherwise(acc * (n - i + 1) / i))


def _without(key: Column, n: Column) -> Column:
    """All texts that are left of ``key`` without ``n`` of its letters, as ``(text, at)``."""

    def cut(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(x["text"])), lambda i: i >= x["at"])  # of several letters the first is cut first
        return F.transform(places, lambda i: F.struct(F.concat(F.substring(x["text"], F.lit(1), i - 1), F.substring(x["text"], i + 1, F.length(x["text"]))).alias("text"), i.alias("at")))

    whole = F.array(F.struct(key.alias("text"), F.lit(1).alias("at")))
    return F.when(n == 0, whole).otherwise(F.aggregate(F.sequence(F.lit(1), n), whole, lambda acc, _: F.flatten(F.transform(acc, cut))))


def _lengths(keys: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``(t, a, b, m, short)``: lengths of keys and of known names that occur in a type and allow the ratio, and with how many letters in common.

    They are ``short`` if neither side leaves more than ``WAYS`` texts when it is cut to ``m`` letters.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    own = keys.select(F.col("ct").alias("t"), F.length("ck").alias("a")).distinct()
    other = known.select(F.col("et").alias("_t"), F.length("ek").alias("b")).distinct()
    both = own.join(other, F.col("t") == F.col("_t")).drop("_t").withColumn("m", F.ceil((a + b) * F.lit(least / 2) - F.lit(1e-9)).cast("int")).where(m <= F.least(a, b))
    return both.withColumn("short", (_ways(a, a - m) <= WAYS) & (_ways(b, b - m) <= WAYS))


def _cut(rows: DataFrame, type_: str, key: str, lengths: DataFrame, length: str) -> DataFrame:
    """``rows`` once for each text ``left`` of their key when it is cut to the numbers of letters ``k`` of its length in ``lengths (t, <length>, k)``."""
    wanted = lengths.groupBy(F.col("t").alias("_t"), F.col(length).alias("_l")).agg(F.collect_set("k").alias("_k"))  # a row for each length of a type
    cut = rows.join(F.broadcast(wanted), (F.col(type_) == F.col("_t")) & (F.length(key) == F.col("_l"))).select(*rows.columns, F.explode("_k").alias("_k"))
    return cut.select(*rows.columns, F.explode(_without(F.col(key), F.length(key) - F.col("_k"))["text"]).alias("left"))


def _bound() -> Column:
    """The ratio of two names if what is left of both is all they have in common."""
    return 2.0 * F.length("left") / (F.length("ck") + F.length("ek"))


def _most_alike(keys: DataFrame, known: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(ct, ck, m (bound, neg, ek))``: of each key the name with which most letters are left, by the smallest id, without a row for each pair.

    Of the names that leave one text only the first of each length is joined.
    """
    first = _cut(known, "et", "ek", lengths, "b").groupBy("et", "left", F.length("ek")).agg(F.min(F.struct("entity_id", "ek")).alias("e")).select("et", F.col("left").alias("_left"), "e.entity_id", "e.ek")
    met = _cut(keys, "ct", "ck", lengths, "a").join(first, (F.col("ct") == F.col("et")) & (F.col("left") == F.col("_left")))
    return met.groupBy("ct", "ck").agg(F.max(F.struct(_bound().alias("bound"), (-F.col("entity_id")).alias("neg"), F.col("ek"))).alias("m"))


def _best_of_short(keys: DataFrame, known: DataFrame, lengths: DataFrame, least: float, further: bool) -> DataFrame:
    """``(ct, ck, entity_id, score)``: of each key's pairs of short lengths the best, at ``least`` or above.

    Two names have ``k`` letters in common, in order, if they are one text when both are cut to ``k``, so what is left of them
    bounds their ratio. One cut letter of a key is tried first, and where lengths allow ``further`` ones, they are if the names found could be surpassed. The
    ratio is taken of the pair with the highest bound alone: if it reaches the bound, none is better. Otherwise, as blocks need
    not match all letters in common, all pairs of the key are compared whose bound is not below the ratio found.
    """
    ratio = _ratio(least)
    levels = lengths.select("t", "a", "b", F.explode(F.sequence("m", F.least("a", "b"))).alias("k"))
    few, more = levels.where("a - k <= 1"), levels.where("a - k > 1")
    top = _most_alike(keys, known, few)
    if further:
        top = top.checkpoint()
        best_left = more.groupBy(F.col("t").alias("_t"), F.col("a").alias("_a")).agg(F.max(2.0 * F.col("k") / (F.col("a") + F.col("b"))).alias("_most"))
        found = top.select(F.col("ct").alias("_ct"), F.col("ck").alias("_ck"), F.col("m.bound").alias("_bound"))
        open_ = keys.join(F.broadcast(best_left), (F.col("ct") == F.col("_t")) & (F.length("ck") == F.col("_a"))).join(found, (F.col("ct") == F.col("_ct")) & (F.col("ck") == F.col("_ck")), "left").where("_bound IS NULL OR _bound <= _most").select("ct", "ck")
        top = top.unionByName(_most_alike(open_, known, more)).groupBy("ct", "ck").agg(F.max("m").alias("m"))
    top = top.select("ct", "ck", F.col("m.bound").alias("bound"), (-F.col("m.neg")).alias("entity_id"), ratio("ck", "m.ek").alias("score")).checkpoint()
    sure = top.where("score = bound").select("ct", "ck", "entity_id", "score")
    rest = top.where("score <> bound").select("ct", "ck", F.greatest("score", F.lit(least)).alias("floor"))
    if rest.isEmpty():
        return sure
    every = _cut(known, "et", "ek", levels, "b").withColumnRenamed("left", "_left")
    pairs = _cut(rest, "ct", "ck", levels, "a").join(every, (F.col("ct") == F.col("et")) & (F.col("left") == F.col("_left"))).where(_bound() >= F.col("floor")).select("ct", "ck", "ek", "entity_id").distinct()
    return sure.unionByName(pairs.select("ct", "ck", "entity_id", ratio("ck", "ek").alias("score")))


def _of_long(keys: DataFrame, known: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """``(ct, ck, entity_id, score)``: pairs of lengths that are not short, by runs of letters."""
    k, e = lengths.select(F.col("t").alias("_t"), F.col("a").alias("_a"), F.col("b").alias("_b")), F.length("ek")
    own = keys.join(F.broadcast(k), (F.col("ct") == F.col("_t")) & (F.length("ck") == F.col("_a")), "left_semi")
    other = known.join(F.broadcast(k), (F.col("et") == F.col("_t")) & (e == F.col("_b")), "left_semi")
    pairs = candidate_pairs(own, other, least).join(F.broadcast(k), (F.col("ct") == F.col("_t")) & (F.length("ck") == F.col("_a")) & (e == F.col("_b")), "left_semi")
    return pairs.select("ct", "ck", "entity_id", _ratio(least)("ck", "ek").alias("score"))


def fuzzy_match(cands: DataFrame, entities: DataFrame, least: float = FUZZY) -> DataFrame:
    """``(id, entity_id, score)``: the most similar entity of the type, at ``least`` or above; ties to the smallest id.

    ``cands (id, entity_type, key)``, ``entities (entity_id, entity_type, entity_key)``. Keys are compared once however many
    candidates have them, and only those that no entity has: an equal key is the most similar one. Short keys meet by what is
    left of them when some letters are cut (:func:`_best_of_short`). Long ones meet in a hash join on type and
    a shared run of letters, within the band of lengths that ``least`` leaves. That loses nothing at 0.88 or above: ``u``
    unmatched letters cut the ``M`` matched ones into ``u + 1`` runs at most, and the ratio makes ``M`` so large that one of
    them has three letters; only where both keys have five letters at most it may have two. Of a key's runs only the rarest
    are joined (:func:`_rare`), so names that share a common word do not meet by it.
    """
    keys = cands.where(F.col("key") != "").select(F.col("entity_type").alias("ct"), F.col("key").alias("ck")).distinct()
    found = best_matches(keys, entities, least)
    return cands.join(found, (F.col("entity_type") == F.col("ct")) & (F.col("key") == F.col("ck"))).select("id", "entity_id", "score")


def best_matches(keys: DataFrame, entities: DataFrame, least: float = FUZZY) -> DataFrame:
    """``(ct, ck, entity_id, score, equal)``: of different ``keys (ct, ck)`` those with a match, and it, as in :func:`fuzzy_match`.

    Known names and keys are kept with ``checkpoint()``, one row for each different name: they are used several times, and what
    they are made from is read once.
    """
    if least < FUZZY:
        raise ValueError(f"runs of three letters find all pairs from {FUZZY} on")
    shared(keys.sparkSession)
    known = entities.where(F.col("entity_key") != "").groupBy(F.col("entity_type").alias("et"), F.col("entity_key").alias("ek")).agg(F.min("entity_id").alias("entity_id")).checkpoint()
    named = keys.join(known.withColumn("equal", F.lit(True)), (F.col("ct") == F.col("et")) & (F.col("ck") == F.col("ek")), "left").select("ct", "ck", "entity_id", "equal").checkpoint()
    equal, unlike = named.where("equal").select("ct", "ck", "entity_id", F.lit(1.0).alias("score"), "equal"), named.where("equal IS NULL").select("ct", "ck")
    lengths = _lengths(unlike, known, least).checkpoint()
    short, further, long = lengths.agg(F.max("short"), F.max(F.col("short") & (F.col("a") - F.col("m") > 1)), F.max(~F.col("short"))).first()  # what there is, null if nothing
    scored = [_best_of_short(unlike, known, lengths.where("short"), least, further)] if short else []
    scored += [_of_long(unlike, known, lengths.where("NOT short"), least)] if long else []
    if not scored:
        return equal
    best = reduce(DataFrame.unionByName, scored).where(F.col("score") >= least).groupBy("ct", "ck").agg(F.max(F.struct(F.col("score"), (-F.col("entity_id")).alias("neg"))).alias("m"))
    return equal.unionByName(best.select("ct", "ck", (-F.col("m.neg")).alias("entity_id"), F.col("m.score").alias("score"), F.lit(False).alias("equal")))


def conflict_keys(cands: DataFrame) -> DataFrame:
    """``(candidate_type, semantic_key, n_values)`` of what is told with different values; one grouping, no self-join."""
    return cands.where(F.col("semantic_key").isNotNull()).groupBy("candidate_type", "semantic_key").agg(F.count_distinct("normalized_value").alias("n_values"), F.count(F.lit(1)).alias("n_candidates")).where("n_values > 1")


def extraction_conflicts(cands: DataFrame) -> DataFrame:
    """Conflict membership: ``(candidate_type, semantic_key, id, normalized_value, status)``."""
    keys = conflict_keys(cands).select(F.col("candidate_type").alias("_t"), F.col("semantic_key").alias("_k"))
    return cands.join(keys, (F.col("candidate_type") == F.col("_t")) & (F.col("semantic_key") == F.col("_k"))).select("candidate_type", "semantic_key", "id", "normalized_value", F.lit("OPEN").alias("status"))


def propose_mapping(cands: DataFrame, entities: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """``mapping_status`` and ``entity_id`` of classified candidates ``(id, classification, raw_value, normalized_value)``.

    Each different key is matched once, exactly or else by similarity, however many candidates have it, and only the matches
    join the candidates. A candidate in an open conflict ``(id)`` is CONFLICT whatever it matches.
    """
    rows = cands.withColumn("_key", entity_key(F.coalesce(F.nullif("normalized_value", F.lit("")), "raw_value", F.lit(""))))
    named = F.col("classification").isin(*ENTITIES)
    keys = rows.where(named & (F.col("_key") != "")).select(F.col("classification").alias("ct"), F.col("_key").alias("ck")).distinct()
    found = best_matches(keys, entities).select(F.col("ct").alias("_et"), F.col("ck").alias("_ek"), F.col("entity_id").alias("_found"), F.col("equal").alias("_equal"))
    joined = rows.join(found, named & (F.col("classification") == F.col("_et")) & (F.col("_key") == F.col("_ek")), "left")
    status = (
        F.when(F.col("classification") == "UNKNOWN", "UNRESOLVED").when(F.col("classification") == "MEASUREMENT", "NOT_REQUIRED").when(~named, "NEW")
        .when(F.col("_key") == "", "UNRESOLVED").when(F.col("_found").isNull(), "NEW").when(F.col("_equal"), "MATCHED").otherwise("POSSIBLE_MATCH")
    )
    if conflicts is not None:
        joined = joined.join(conflicts.select(F.col("id").alias("_c")).distinct(), F.col("id") == F.col("_c"), "left")
        status = F.when(F.col("_c").isNotNull(), "CONFLICT").otherwise(status)
    return joined.withColumns({"mapping_status": status, "entity_id": F.col("_found")}).drop("_key", "_et", "_ek", "_found", "_equal", "_c")


def resolve_identity(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """``identity_status`` and ``entity_id`` of ``cands (id, name, code, parent, lat, lon)`` among ``entities (entity_id, canonical_name, aliases, domain_code, parent, lat, lon)``.

    In order: code, exact name or alias, same parent and similarity of 0.75, a point within 0.01 degrees, similarity of 0.88.
    Each rule is an equality join; the first that finds something decides.
    """
    plain = lambda c: name_key(F.coalesce(c, F.lit("")))
    fold = lambda c: case_fold(F.coalesce(c, F.lit("")))
    c = cands.select("id", plain(F.col("name")).alias("key"), F.trim(fold(F.col("code"))).alias("code"), fold(F.col("parent")).alias("parent"), "lat", "lon")
    e = entities.select("entity_id", plain(F.col("canonical_name")).alias("ek"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), plain).alias("keys"), fold(F.col("domain_code")).alias("ecode"), fold(F.col("parent")).alias("eparent"), F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    rule = lambda df, rank, status: df.select("id", F.lit(rank).alias("rank"), F.col("entity_id"), status.alias("status"))
    other = (F.col("key") != "") & (F.col("key") != F.col("ek")) & ~F.array_contains("keys", F.col("key"))
    by_code = rule(c.where("code <> ''").join(e.where("ecode <> ''"), F.col("code") == F.col("ecode")), 1, F.when(other, "POSSIBLE_MATCH").otherwise("MATCHED"))
    names = e.withColumn("any_key", F.explode(F.array_distinct(F.concat(F.array("ek"), "keys")))).where("any_key <> ''")
    clash = (F.col("parent") != "") & (F.col("eparent") != "") & (F.col("parent") != F.col("eparent"))
    by_name = rule(c.join(names, F.col("key") == F.col("any_key")), 2, F.when(clash, "CONFLICT").otherwise("MATCHED"))
    ratio = _ratio()
    kin = c.where("parent <> '' AND key <> ''").join(e, F.col("parent") == F.col("eparent")).withColumn("r", ratio("key", "ek")).where("r >= 0.75")
    by_parent = rule(kin, 3, F.lit("POSSIBLE_MATCH"))
    cell = lambda v: F.floor(v / 0.01)
    around = c.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("cy", F.explode(F.sequence(cell(F.col("lat")) - 1, cell(F.col("lat")) + 1))).withColumn("cx", F.explode(F.sequence(cell(F.col("lon")) - 1, cell(F.col("lon")) + 1)))
    near = around.join(e.where("elat IS NOT NULL AND elon IS NOT NULL").withColumns({"ey": cell(F.col("elat")), "ex": cell(F.col("elon"))}), (F.col("cy") == F.col("ey")) & (F.col("cx") == F.col("ex"))).where(F.hypot(F.col("lat") - F.col("elat"), F.col("lon") - F.col("elon")) <= 0.01)
    by_place = rule(near, 4, F.lit("POSSIBLE_MATCH"))
    fuzzy = fuzzy_match(c.select("id", F.lit("x").alias("entity_type"), "key"), e.select("entity_id", F.lit("x").alias("entity_type"), F.col("ek").alias("entity_key")))
    by_likeness = rule(fuzzy, 5, F.lit("POSSIBLE_MATCH"))
    every = by_code.unionByName(by_name).unionByName(by_parent).unionByName(by_place).unionByName(by_likeness)
    first = every.groupBy(F.col("id").alias("_i")).agg(F.min(F.struct("rank", "entity_id", "status")).alias("m"))
    joined = c.join(first, F.col("id") == F.col("_i"), "left")
    nothing = (F.col("key") == "") & (F.col("code") == "")
    return joined.select("id", F.when(nothing, "UNRESOLVED").otherwise(F.coalesce("m.status", F.lit("NEW"))).alias("identity_status"), F.when(~nothing, F.col("m.entity_id")).alias("entity_id"))


def resolve_conflicts(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts ``(conflict_id, status)`` after ``resolutions (conflict_id, resolution)``: only OPEN and UNDER_REVIEW ones change."""
    r = resolutions.select(F.col("conflict_id").alias("_c"), "resolution")
    joined = conflicts.join(r, F.col("conflict_id") == F.col("_c"), "left")
    change = F.col("resolution").isNotNull() & F.col("status").isin("OPEN", "UNDER_REVIEW")
    return joined.withColumns({"changed": change, "status": F.when(change, F.col("resolution")).otherwise(F.col("status"))}).drop("_c", "resolution")


def class_counts(cands: DataFrame) -> DataFrame:
    return cands.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def status_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(source, status, n)``: rows of each table by status, or altogether where it has none."""
    out = None
    for name, df in tables.items():
        status = F.col("status") if "status" in df.columns else F.lit("TOTAL")
        part = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "status", "n")
        out = part if out is None else out.unionByName(part)
    return out


def queue_filter(cands: DataFrame, status: str | None = None, classification: str | None = None, document_id=None, page_id=None, validation: str | None = None) -> DataFrame:
    for name, want in (("verification_status", status), ("classification", classification), ("document_id", document_id), ("page_id", page_id)):
        if want is not None:
            cands = cands.where(F.col(name) == want)
    return cands.where(has_validation(F.col("validation_results"), validation)) if validation else cands


def queue_search(cands: DataFrame, pages: DataFrame, contents: DataFrame, q: str) -> DataFrame:
    """Candidates for a search text. Digits mean a page number or an exact value; other text is a pattern (``%`` and ``_`` stand for others) looked for in the candidate, its content unit, its page's number and its document's name.

    ``pages (page_id, page_number, document_name)``, ``contents (content_id, content_text)``.
    """
    q = q.strip().lower()
    joined = cands.join(pages.withColumnRenamed("page_id", "_p"), F.col("page_id") == F.col("_p"), "left")
    if not q.isdigit():
        joined = joined.join(contents.withColumnRenamed("content_id", "_c"), F.col("content_id") == F.col("_c"), "left").drop("_c")
    if q.isdigit():
        hit = (F.col("page_number") == int(q)) | (F.lower("raw_value") == q) | (F.lower("normalized_value") == q)
    else:
        hit = F.lit(False)
        for c in ("raw_text", "raw_value", "normalized_value", "candidate_type", "classification", "document_name", "page_number", "content_text"):
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).like(f"%{q}%"), F.lit(False))
    return joined.where(F.coalesce(hit, F.lit(False))).drop("_p")


def conflict_filter(cands: DataFrame, conflicts: DataFrame, present: bool = True, status: str | None = None) -> DataFrame:
    """Candidates in a conflict ``(id, status)``, in one of a status, or in none."""
    c = conflicts.where(F.col("status") == status) if status else conflicts
    return cands.join(c.select("id").distinct(), "id", "left_semi" if present else "left_anti")


def candidate_detail(cands: DataFrame, documents: DataFrame, pages: DataFrame, proposals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Candidates with document, page, proposal and number of conflicts, joined once for all of them."""
    n = conflicts.groupBy("id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    return cands.join(documents, "document_id", "left").join(pages, "page_id", "left").join(proposals, "id", "left").join(n, "id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
