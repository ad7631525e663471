"""Production analytics: verified records, issues, groups, trends, statistics, anomalies, checks and batch calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import convert_units, normalize_units
from .paging import numbered
from .quantiles import LIMIT, kept, kept_values, quantiles

# The years a period may name, and the kinds of groups.
YEAR = r"(?<!\d)(18\d{2}|19\d{2}|20\d{2}|21\d{2}|2200)(?!\d)"
GROUPS = ("year", "state", "mine", "company", "commodity")


def reporting_year(period: Column) -> Column:
    """The first year from 1800 to 2200 in a period that is not part of a longer number."""
    return F.nullif(F.regexp_extract(period, YEAR, 1), F.lit("")).cast("int")


def trusted_only(df: DataFrame, records: DataFrame) -> DataFrame:
    """Rows that are VERIFIED by the verifier whom their verification record names."""
    return df.join(records, df.verification_id == records.record_key).where((F.col("status") == "VERIFIED") & (F.col("verified_by") == F.col("verifier_id"))).drop("record_key", "verified_by")


def verified_production(production: DataFrame, records: DataFrame, projects: DataFrame, mines: DataFrame) -> DataFrame:
    """Trusted production with its project and its mine, the project's mine where the record names none."""
    trusted = trusted_only(production, records)
    m = mines.select(F.col("mine_id").alias("m_id"), F.col("canonical_name").alias("mine"), "state", "operator")
    with_project = trusted.join(projects.withColumnRenamed("project_id", "p_id"), F.col("project_id") == F.col("p_id"), "left")
    joined = with_project.join(m, F.coalesce("mine_id", "project_mine_id") == F.col("m_id"), "left")
    out = joined.withColumns({"company": F.coalesce("operator", "organization"), "year": reporting_year(F.col("period")), "provenance": provenance(joined.columns)})
    return out.drop("p_id", "m_id", "operator", "organization", "project_mine_id")


#: Where a production record comes from.
PROVENANCE = ("source_candidate_id", "verification_id", "verifier_id", "source_document_id", "source_version_id", "source_page_id", "source_content_id", "source_table_id", "source_cell_id")


def provenance(columns: list[str]) -> Column:
    """The record's id and its sources as text; null where the table does not have them."""
    return F.struct(F.col("record_id").cast("string").alias("id"), *[(F.col(c) if c in columns else F.lit(None)).cast("string").alias(c) for c in PROVENANCE])


def filter_production(df: DataFrame, mine_id=None, project_id=None, year=None, year_from=None, year_to=None, state=None, commodity=None, record_ids: DataFrame | None = None) -> DataFrame:
    """The filters that are given, all of them; names compare without case; ``record_ids`` is a table with that column."""
    if year is not None and (year_from is not None or year_to is not None):
        raise ValueError("a year and a range of years exclude each other")
    if year_from is not None and year_to is not None and year_from > year_to:
        raise ValueError("the range of years is empty")
    for name, want in (("mine_id", mine_id), ("project_id", project_id), ("year", year)):
        if want is not None:
            df = df.where(F.col(name) == want)
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    for name, want in (("state", state), ("commodity", commodity)):
        if want:
            df = df.where(F.ilike(F.col(name), F.lit(want)))
    if record_ids is not None:
        df = df.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    return df


def checked(df: DataFrame) -> DataFrame:
    """Production with normalized ``tonnes`` and the array ``issues``; ``usable`` rows go on to analytics."""
    out = normalize_units(df)
    bad_unit = F.col("unit_issue").isNotNull() | (F.col("dimension") != "mass")
    negative = ~bad_unit & (F.col("normalized_value") < 0)
    issues = F.array_compact(F.array(
        F.when(bad_unit, "INVALID_UNIT_OR_VALUE"),
        F.when(~bad_unit & F.col("year").isNull(), "MISSING_REPORTING_YEAR"),
        F.when(~bad_unit & F.col("mine_id").isNull() & F.col("project_id").isNull(), "MISSING_ENTITY_REFERENCE"),
        F.when(negative, "NEGATIVE_PRODUCTION"),
    ))
    return out.withColumns({"issues": issues, "usable": ~bad_unit & ~negative, "tonnes": F.col("normalized_value")})


def usable(df: DataFrame) -> DataFrame:
    return checked(df).where("usable").drop("issues", "usable")


def production_issues(df: DataFrame) -> DataFrame:
    """One row for each issue of each record."""
    return checked(df).select("record_id", F.explode("issues").alias("issue"))


def issue_checks(issues: DataFrame) -> DataFrame:
    """Issues as validation rows with severity and status."""
    missing = F.col("issue").startswith("MISSING_")
    return issues.select(F.col("issue").alias("validation_type"), F.when(missing, "WARNING").otherwise("ERROR").alias("severity"), F.when(missing, "REVIEW_REQUIRED").otherwise("FAILED").alias("status"), "record_id")


def group_production(df: DataFrame, by: str, value: str = "tonnes", with_records: bool = False) -> DataFrame:
    """Total and number of records by year, state, mine, company or commodity; a missing key is ``UNSPECIFIED``; keys are text."""
    if by not in GROUPS:
        raise ValueError(f"group by one of {', '.join(GROUPS)}")
    aggregates = [F.sum(value).cast("decimal(38,9)").alias("total"), F.count(F.lit(1)).alias("record_count")]
    if with_records:
        aggregates.append(F.sort_array(F.collect_list("record_id")).alias("source_record_ids"))
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("UNSPECIFIED")).alias("key")).agg(*aggregates)


def yearly(df: DataFrame, value: str = "tonnes") -> DataFrame:
    """Totals of each year; records without a year are left out."""
    return df.where(F.col("year").isNotNull()).groupBy("year").agg(F.sum(value).cast("decimal(38,9)").alias("value"), F.count(F.lit(1)).alias("record_count"))


def trend_changes(observations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Change and percent change from the year before in the data; percent is null after a zero."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("year")
    out = observations.withColumns({"from_year": F.lag("year").over(w), "before": F.lag("value").over(w)})
    return out.where(F.col("from_year").isNotNull()).select(*keys, "from_year", F.col("year").alias("to_year"), (F.col("value") - F.col("before")).alias("change"), (F.try_divide((F.col("value") - F.col("before")).cast("double"), F.col("before").cast("double")) * 100).alias("change_percent"))


def cagr(observations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Endpoint growth rate over elapsed years, in percent; null unless years differ and the first value is positive."""
    ends = observations.groupBy(*keys).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("value", "year").cast("double").alias("first"), F.max_by("value", "year").cast("double").alias("last"))
    n = F.col("last_year") - F.col("first_year")
    return ends.select(*keys, "first_year", "last_year", F.when((n > 0) & (F.col("first") > 0), (F.pow(F.col("last") / F.col("first"), F.lit(1.0) / n) - 1) * 100).alias("cagr_percent"))


def statistics(df: DataFrame, value: str, keys: tuple[str, ...] = (), percentile: float = 50, limit: int = LIMIT) -> DataFrame:
    """Count, sum, mean, median, extremes, population deviation and an interpolated percentile of what is not null.

    No task holds more than ``limit`` values of a group. An empty table without keys gives one row of nulls.
    """
    if not 0 <= percentile <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    rows, own = kept_values(df, value, keys), [f"k{i}" for i in range(len(keys))]
    v = F.col("v").cast("double")
    plain = rows.groupBy(*own).agg(F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg(v).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop(v).alias("stddev_pop"))
    q = quantiles(rows, len(keys), [0.5, percentile / 100], limit).select(*[F.col(k).alias(f"_{k}") for k in own], "q")
    joined = plain.join(q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in own]) if keys else plain.crossJoin(F.broadcast(q))  # one row
    return joined.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n", "sum", "mean", F.get("q", F.lit(0)).alias("median"), "min", "max", "stddev_pop", F.get("q", F.lit(1)).alias("percentile"))


def anomalies(df: DataFrame, value: str, method: str = "z_score", threshold: float = 3.0, keys: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """``df`` with ``score`` and ``anomaly`` (ANOMALY or NORMAL) against the statistics of all rows, or of the rows of the same keys.

    ``z_score``: distance from the mean in population deviations, over the threshold. ``iqr``: outside the quartiles by
    more than ``threshold`` times their distance; the score is how far outside. No task holds more than ``limit`` values of
    a group to find its quartiles.
    """
    v = F.col(value).cast("double")
    key = [F.col(k).alias(f"_{k}") for k in keys]
    if method == "z_score":
        stats = df.groupBy(*key).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    elif method == "iqr":
        df = kept(df)  # computed once, for quartiles and scores
        rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v"))
        q = quantiles(rows, len(keys), [0.25, 0.75], limit)
        stats = q.select(*[F.col(f"k{i}").alias(f"_{k}") for i, k in enumerate(keys)], F.get("q", F.lit(0)).alias("_a"), F.get("q", F.lit(1)).alias("_b"))
    else:
        raise ValueError("a method is z_score or iqr")
    joined = df.join(stats, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left") if keys else df.crossJoin(F.broadcast(stats))  # one row
    if method == "z_score":
        score = F.when(F.col("_s") > 0, F.abs(v - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
        flag = score > threshold
    else:
        reach = threshold * (F.col("_b") - F.col("_a"))
        score = F.greatest(F.col("_a") - reach - v, v - F.col("_b") - reach, F.lit(0.0))
        flag = score > 0
    return joined.withColumns({"score": score, "anomaly": F.when(flag, "ANOMALY").otherwise("NORMAL")}).drop(*[f"_{k}" for k in keys], "_m", "_s", "_a", "_b")


def _with_entity(df: DataFrame) -> DataFrame:
    entity = F.coalesce(F.concat(F.lit("mine:"), F.col("mine_id")), F.concat(F.lit("project:"), F.col("project_id")))
    return df.withColumns({"entity": entity, "commodity_key": F.lower(F.coalesce("commodity", F.lit("")))})


def cross_source_checks(df: DataFrame, value: str = "tonnes") -> DataFrame:
    """Entities with several records for a period and commodity: duplicates where values agree, conflicts where not."""
    rows = _with_entity(df).where(F.col("entity").isNotNull())
    groups = rows.groupBy("entity", "period", "commodity_key").agg(F.count(F.lit(1)).alias("n_records"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("n_records > 1")
    same = F.col("lo") == F.col("hi")
    return groups.select("entity", "period", "commodity_key", "n_records", F.when(same, "DUPLICATE_OBSERVATION").otherwise("CONFLICTING_PRODUCTION_VALUES").alias("validation_type"), F.when(same, "WARNING").otherwise("ERROR").alias("severity"), F.when(same, "DUPLICATE").otherwise("CONFLICT").alias("status"), (F.col("hi") - F.col("lo")).alias("difference"))


def contradictions(checks: DataFrame) -> DataFrame:
    """One row: whether any conflict was found."""
    return checks.agg(F.coalesce(F.max(F.when(F.col("status") == "CONFLICT", "CONTRADICTIONS_FOUND")), F.lit("NO_CONTRADICTIONS")).alias("status"))


def zero_safe(numerator: Column, denominator: Column, on_error: str = "status") -> Column:
    """``struct(value, status)``: ``missing_input`` for nulls, ``zero_denominator``, or ``ok``; ``on_error="raise"`` fails on zero."""
    zero = F.raise_error(F.lit("zero denominator")).cast("double") if on_error == "raise" else F.lit(None).cast("double")
    missing = numerator.isNull() | denominator.isNull()
    value = F.when(missing, None).when(denominator == 0, zero).otherwise(numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double"))
    return F.struct(value.alias("value"), F.when(missing, "missing_input").when(denominator == 0, "zero_denominator").otherwise("ok").alias("status"))


def percentage(part: Column, whole: Column, on_error: str = "status") -> Column:
    r = zero_safe(part, whole, on_error)
    return F.struct((r["value"] * 100).alias("value"), r["status"].alias("status"))


def with_units(df: DataFrame, kind: str, first: str, first_unit: str, second: str, second_unit: str, name: str = "result") -> DataFrame:
    """Add ``name``, ``struct(value, unit, status)``: a calculation of two amounts in units of their own.

    ``production_difference``, ``growth_percentage``, ``production_share`` and ``stripping_ratio`` bring the second amount
    into the unit of the first; ``productivity`` takes a mass and man-shifts. ``status`` is ``ok``, ``missing_input``,
    ``unsupported_unit``, ``incompatible_units``, ``wrong_dimension`` or ``zero_denominator``.
    """
    if kind not in ("production_difference", "growth_percentage", "production_share", "stripping_ratio", "productivity"):
        raise ValueError(f"no calculation {kind}")
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    missing = F.when(a.isNull() | b.isNull(), "missing_input")
    if kind == "productivity":
        out = normalize_units(df.withColumn("_one", F.lit("1")), "_one", first_unit).withColumnRenamed("dimension", "_first_dimension").drop("normalized_value", "normalized_unit", "conversion_rule", "unit_issue")
        out = normalize_units(out, "_one", second_unit).withColumnRenamed("dimension", "_second_dimension").drop("normalized_value", "normalized_unit", "conversion_rule", "unit_issue", "_one")
        fits = F.coalesce((F.col("_first_dimension") == "mass") & (F.col("_second_dimension") == "labor"), F.lit(False))
        status = F.when(~fits, "wrong_dimension").otherwise(F.coalesce(missing, F.when(b == 0, "zero_denominator"), F.lit("ok")))
        value, unit, gone = F.try_divide(a, b), F.concat(F.col(first_unit), F.lit("/man-shift")), ("_first_dimension", "_second_dimension")
    else:
        out = convert_units(df, second, second_unit, first_unit)
        b = F.col("converted").cast("double")
        issue = F.when(F.col("convert_issue") == "UNSUPPORTED", "unsupported_unit").when(F.col("convert_issue") == "INCOMPATIBLE", "incompatible_units")
        zero = F.when((b == 0) & (kind != "production_difference"), "zero_denominator")
        status = F.coalesce(missing, issue, zero, F.lit("ok"))
        value = {"production_difference": a - b, "growth_percentage": F.try_divide(a - b, b) * 100, "production_share": F.try_divide(a, b) * 100, "stripping_ratio": F.try_divide(a, b)}[kind]
        unit, gone = {"production_difference": F.col(first_unit), "stripping_ratio": F.lit("t/t")}.get(kind, F.lit("%")), ("converted", "convert_issue")
    return out.withColumn(name, F.struct(F.when(status == "ok", value).alias("value"), unit.alias("unit"), status.alias("status"))).drop(*gone)


def growth(current: Column, previous: Column, on_error: str = "status") -> Column:
    """Percent change from ``previous`` to ``current``, both in one unit."""
    return percentage(current - previous, previous, on_error)


def area(length: Column, width: Column) -> Column:
    """``struct(value, status)`` of two lengths in one unit; a negative length is an error."""
    missing = length.isNull() | width.isNull()
    bad = (length < 0) | (width < 0)
    return F.struct(F.when(~missing & ~bad, length * width).alias("value"), F.when(missing, "missing_input").when(bad, "negative_length").otherwise("ok").alias("status"))


def stripping_ratio(overburden: Column, coal: Column, on_error: str = "status") -> Column:
    """Overburden over coal, both masses in one unit."""
    return zero_safe(overburden, coal, on_error)


def productivity(output: Column, manshifts: Column, on_error: str = "status") -> Column:
    """Output per man-shift."""
    return zero_safe(output, manshifts, on_error)


def period_over_period(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Differences and percent changes along ``order``, nulls taken out first."""
    v = F.col(value).cast("double")
    if keys:
        out = df.where(F.col(value).isNotNull()).withColumn("previous", F.lag(v).over(Window.partitionBy(*keys).orderBy(order)))
    else:  # one sequence of all rows: ranges of it are numbered side by side, and each row meets the one before by number
        rows = numbered(df.where(F.col(value).isNotNull()), [F.col(order)], "_at")
        before = rows.select((F.col("_at") + 1).alias("_next"), v.alias("previous"))
        out = rows.join(before, F.col("_at") == F.col("_next"), "left").drop("_at", "_next")
    out = out.where(F.col("previous").isNotNull())
    return out.withColumns({"difference": v - F.col("previous"), "percent": F.try_divide(v - F.col("previous"), F.col("previous")) * 100})


PAIRS = ("production_difference", "growth_percentage", "cagr", "production_share")
KINDS = (*PAIRS, "sum", "average", "minimum", "maximum", "median", "standard_deviation", "stripping_ratio", "productivity")


def calculate(requests: DataFrame, production: DataFrame) -> DataFrame:
    """``(request_id, kind, status, value, n_inputs)`` for ``requests (request_id, kind, record_ids, years)``.

    Two-record kinds need two records of one entity and commodity in different periods (shares need neither). A record that
    is not there gives ``INSUFFICIENT_VERIFIED_DATA``, as do the two kinds whose inputs production does not hold.
    """
    # requests of one list of records share its rows: lists are told apart by a digest and meet in the task that holds them
    keyed = requests.withColumn("_set", F.sha2(F.to_json(F.struct("record_ids")), 256))
    lists = keyed.groupBy("_set").agg(F.first("record_ids").alias("record_ids"))
    ids = lists.select("_set", F.explode_outer(F.array_distinct("record_ids")).alias("rid"))
    rows = production.select("record_id", "mine_id", "project_id", "commodity", "year", "period", "tonnes")
    joined = ids.join(rows, F.col("rid") == F.col("record_id"), "left")
    v = F.col("tonnes").cast("double")
    order = F.struct(F.coalesce("year", F.lit(-1)).alias("y"), F.col("period").alias("p"), F.col("record_id").alias("r"))
    entity = F.struct("mine_id", "project_id", "commodity")
    g = joined.groupBy("_set").agg(
        F.count("record_id").alias("n_inputs"), F.count("rid").alias("wanted"),
        (F.min(entity) != F.max(entity)).alias("entities_differ"), F.coalesce(F.min("period") != F.max("period"), F.lit(False)).alias("periods_differ"),
        F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"), F.sum(v).alias("s"), F.avg(v).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.median(v).alias("med"), F.stddev_pop(v).alias("sd"),
        F.min_by(v, "rid").alias("one"), F.max_by(v, "rid").alias("two"),
    )
    asked = keyed.groupBy("request_id", "kind", "_set").agg(F.max("years").alias("years"))
    g = asked.join(g, "_set")
    kind = F.col("kind")
    pair = kind.isin(*PAIRS)
    ordered = kind.isin("production_difference", "growth_percentage", "cagr")
    status = (
        F.when(~kind.isin(*KINDS), "UNSUPPORTED_KIND")
        .when(kind.isin("stripping_ratio", "productivity") | (F.col("n_inputs") == 0) | (F.col("n_inputs") < F.col("wanted")), "INSUFFICIENT_VERIFIED_DATA")
        .when(pair & (F.col("n_inputs") != 2), "NEEDS_TWO_RECORDS")
        .when(ordered & F.col("entities_differ"), "DIFFERENT_ENTITIES")
        .when(ordered & ~F.col("periods_differ"), "SAME_PERIOD")
        .when((kind == "cagr") & (F.coalesce("years", F.lit(0)) <= 0), "NEEDS_YEARS")
        .when((kind == "growth_percentage") & (F.col("first") == 0) | (kind == "production_share") & (F.col("two") == 0) | (kind == "cagr") & (F.col("first") <= 0), "ZERO_BASE")
        .otherwise("OK")
    )
    value = (
        F.when(kind == "production_difference", F.col("last") - F.col("first"))
        .when(kind == "growth_percentage", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100)
        .when(kind == "production_share", F.try_divide(F.col("one"), F.col("two")) * 100)
        .when(kind == "cagr", (F.pow(F.try_divide("last", "first"), F.try_divide(F.lit(1.0), F.col("years"))) - 1) * 100)
        .when(kind == "sum", F.col("s")).when(kind == "average", F.col("a")).when(kind == "minimum", F.col("lo")).when(kind == "maximum", F.col("hi")).when(kind == "median", F.col("med")).when(kind == "standard_deviation", F.col("sd"))
    )
    return g.select("request_id", "kind", status.alias("status"), F.when(status == "OK", value).alias("value"), "n_inputs")


def production_report(df: DataFrame) -> DataFrame:
    """``(section, key, value, detail)``: totals by state and year, checks by type, and, from three records on, anomalies of yearly totals."""
    # records are joined and checked once: every section adds up these cells
    good = _with_entity(usable(df)).groupBy("state", "year", "entity", "period", "commodity_key").agg(F.sum("tonnes").alias("tonnes"), F.count(F.lit(1)).alias("n"), F.min("tonnes").alias("lo"), F.max("tonnes").alias("hi")).checkpoint()

    def total(by: str) -> DataFrame:
        sums = good.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("UNSPECIFIED")).alias("key")).agg(F.sum("tonnes").cast("decimal(38,9)").alias("total"), F.sum("n").alias("record_count"))
        return sums.select(F.lit(f"by_{by}").alias("section"), "key", F.col("total").cast("double").alias("value"), F.col("record_count").cast("string").alias("detail"))

    by = [total(g) for g in ("state", "year")]
    groups = good.where(F.col("entity").isNotNull()).groupBy("entity", "period", "commodity_key").agg(F.sum("n").alias("n_records"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n_records > 1")
    checks = groups.select(F.when(F.col("lo") == F.col("hi"), "DUPLICATE_OBSERVATION").otherwise("CONFLICTING_PRODUCTION_VALUES").alias("validation_type")).groupBy("validation_type").count().select(F.lit("checks").alias("section"), F.col("validation_type").alias("key"), F.col("count").cast("double").alias("value"), F.lit(None).cast("string").alias("detail"))
    years = good.where(F.col("year").isNotNull()).groupBy("year").agg(F.sum("tonnes").cast("decimal(38,9)").alias("value"), F.sum("n").alias("record_count"))
    enough = years.agg(F.sum("record_count").alias("n")).where("n >= 3")
    odd = anomalies(years, "value", "z_score", 2.0).crossJoin(F.broadcast(enough)).select(F.lit("anomalies").alias("section"), F.col("year").cast("string").alias("key"), F.col("score").alias("value"), F.col("anomaly").alias("detail"))
    return by[0].unionByName(by[1]).unionByName(checks).unionByName(odd)
