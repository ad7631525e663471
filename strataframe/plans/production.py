"""Production queries over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..operators import production as op
from ..operators.paging import latest
from ..sources import views

_VERIFIED = views.SQL + """,
trusted AS (SELECT p.* FROM production p JOIN records ON verification_id = record_key WHERE status = 'VERIFIED' AND verified_by = verifier_id),
verified AS (
  SELECT t.*, m.canonical_name AS mine, m.state, coalesce(m.operator, j.organization) AS company,
         CAST(nullif(regexp_extract(period, '(18[0-9]{2}|19[0-9]{2}|20[0-9]{2}|21[0-9]{2}|2200)', 1), '') AS INTEGER) AS year
  FROM trusted t LEFT JOIN projects j ON t.project_id = j.project_id LEFT JOIN mines m ON coalesce(t.mine_id, j.project_mine_id) = m.mine_id),
normal AS (
  SELECT *, CASE unit WHEN 't' THEN value * 1.0 WHEN 'tonnes' THEN value * 1.0 WHEN 'kg' THEN value * 0.001 WHEN 'Mt' THEN value * 1000000.0 END::DECIMAL(29,9) AS tonnes FROM verified),
good AS (SELECT * FROM normal WHERE tonnes IS NOT NULL AND tonnes >= 0)
"""


def _sql(tail: str) -> str:
    return f"WITH {_VERIFIED} {tail}"


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.verified_production(views.production(spark, sf_dir), views.records(spark, sf_dir), views.projects(spark, sf_dir), views.mines(spark, sf_dir))


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.usable(verified(spark, sf_dir))


def _six(name: str) -> F.Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def _grouped(by: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.group_production(good(spark, sf_dir), by).select("key", _six("total"), "record_count")

    return run, _sql(f"SELECT coalesce(CAST({by} AS VARCHAR), 'UNSPECIFIED') AS key, round(sum(tonnes)::DOUBLE, 6) AS total, count(*) AS record_count FROM good GROUP BY 1")


def verified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("record_id", "mine", "state", "company", "period", "year", "commodity", "unit", _six("value"), F.col("provenance.id").alias("provenance_id"), F.col("provenance.verification_id").alias("provenance_verification"), F.col("provenance.verifier_id").alias("provenance_verifier"), F.col("provenance.source_page_id").alias("provenance_page"))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.filter_production(verified(spark, sf_dir), year_from=1996, year_to=1999, state="nation_1%", commodity="economy")
    return out.select("record_id", "state", "year", "commodity")


def by_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.production(spark, sf_dir).where(F.col("mine_id") % 5 == 0).select("record_id")
    return op.filter_production(verified(spark, sf_dir), record_ids=ids).select("record_id", "mine_id")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.production_issues(verified(spark, sf_dir))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.issue_checks(issues(spark, sf_dir)).groupBy("validation_type", "severity", "status").agg(F.count(F.lit(1)).alias("n"))


_ISSUES = _sql("""SELECT record_id, issue FROM (
  SELECT record_id, CASE WHEN tonnes IS NULL THEN 'INVALID_UNIT_OR_VALUE' END AS issue FROM normal UNION ALL
  SELECT record_id, CASE WHEN tonnes IS NOT NULL AND year IS NULL THEN 'MISSING_REPORTING_YEAR' END FROM normal UNION ALL
  SELECT record_id, CASE WHEN tonnes IS NOT NULL AND mine_id IS NULL AND project_id IS NULL THEN 'MISSING_ENTITY_REFERENCE' END FROM normal UNION ALL
  SELECT record_id, CASE WHEN tonnes < 0 THEN 'NEGATIVE_PRODUCTION' END FROM normal) WHERE issue IS NOT NULL""")


def count_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.normalize_units(views.production(spark, sf_dir))
    return out.select("record_id", F.round(F.col("normalized_value").cast("double"), 6).alias("normalized_value"), "normalized_unit", "dimension", "unit_issue")


_NORMALIZED = f"""WITH {views.SQL} SELECT record_id, round((value * CASE unit WHEN 'kg' THEN 0.001 WHEN 'Mt' THEN 1000000.0 WHEN 'MT' THEN NULL ELSE 1.0 END)::DOUBLE, 6) AS normalized_value,
  CASE WHEN unit = 'MT' THEN NULL WHEN unit = 'Rs' THEN 'Rs' ELSE 't' END AS normalized_unit, CASE WHEN unit = 'MT' THEN NULL WHEN unit = 'Rs' THEN 'currency' ELSE 'mass' END AS dimension,
  CASE WHEN unit = 'MT' THEN 'AMBIGUOUS' END AS unit_issue FROM production"""


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.convert_units(views.production(spark, sf_dir).withColumn("wanted", F.lit("kg")), "value", "unit", "wanted")
    return out.select("record_id", F.round(F.col("converted").cast("double"), 3).alias("converted"), "convert_issue")


_CONVERTED = f"""WITH {views.SQL} SELECT record_id, round((value * CASE unit WHEN 'kg' THEN 1 WHEN 't' THEN 1000 WHEN 'tonnes' THEN 1000 WHEN 'Mt' THEN 1000000000 END)::DOUBLE, 3) AS converted,
  CASE unit WHEN 'MT' THEN 'UNSUPPORTED' WHEN 'Rs' THEN 'INCOMPATIBLE' END AS convert_issue FROM production"""


def extraction_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.normalize_units(views.production(spark, sf_dir), rows=units.EXTRACTION_UNITS)
    return out.groupBy("unit", "normalized_unit", "unit_issue").agg(F.count(F.lit(1)).alias("n"))


_EXTRACTION_UNITS = f"""WITH {views.SQL} SELECT unit, CASE WHEN unit IN ('t', 'tonnes', 'Mt') THEN 't' END AS normalized_unit,
  CASE WHEN unit = 'MT' THEN 'AMBIGUOUS' WHEN unit IN ('kg', 'Rs') THEN 'UNSUPPORTED' END AS unit_issue, count(*) AS n FROM production GROUP BY 1, 2, 3"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.yearly(good(spark, sf_dir)).select("year", _six("value"), "record_count")


def _by_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = good(spark, sf_dir).where(F.col("year").isNotNull() & F.col("mine_id").isNotNull())
    return rows.groupBy("mine_id", "year").agg(F.sum("tonnes").cast("decimal(38,9)").alias("value"))


_BY_MINE = "by_mine AS (SELECT mine_id, year, sum(tonnes) AS value FROM good WHERE year IS NOT NULL AND mine_id IS NOT NULL GROUP BY 1, 2)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.trend_changes(_by_mine(spark, sf_dir), ("mine_id",)).select("mine_id", "from_year", "to_year", _six("change"), F.round("change_percent", 4).alias("change_percent"))


def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cagr(_by_mine(spark, sf_dir), ("mine_id",)).select("mine_id", "first_year", "last_year", F.round("cagr_percent", 6).alias("cagr_percent"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.statistics(good(spark, sf_dir), "tonnes", ("commodity",), 90)
    return out.select("commodity", "n", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("sum", "mean", "median", "min", "max", "stddev_pop", "percentile")])


def _anomalies(method: str, threshold: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op.anomalies(_by_mine(spark, sf_dir), "value", method, threshold, ("mine_id",))
        return out.select("mine_id", "year", F.round("score", 3).alias("score"), "anomaly")

    return run


def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cross_source_checks(good(spark, sf_dir)).select("entity", "period", "commodity_key", "n_records", "validation_type", "severity", "status", _six("difference"))


_CROSS = """SELECT coalesce('mine:' || mine_id, 'project:' || project_id) AS entity, period, lower(commodity) AS commodity_key, count(*) AS n_records,
  CASE WHEN min(tonnes) = max(tonnes) THEN 'DUPLICATE_OBSERVATION' ELSE 'CONFLICTING_PRODUCTION_VALUES' END AS validation_type,
  CASE WHEN min(tonnes) = max(tonnes) THEN 'WARNING' ELSE 'ERROR' END AS severity, CASE WHEN min(tonnes) = max(tonnes) THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status,
  round((max(tonnes) - min(tonnes))::DOUBLE, 6) AS difference FROM good WHERE mine_id IS NOT NULL OR project_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.contradictions(op.cross_source_checks(good(spark, sf_dir)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good(spark, sf_dir).groupBy("commodity").agg(F.round(F.sum("tonnes").cast("double"), 6).alias("total"), F.round(F.avg(F.col("tonnes").cast("double")), 3).alias("average"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")
    zero = F.when(F.col("l_linenumber") == 3, F.lit(0.0)).when(F.col("l_linenumber") == 5, F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
    out = l.select("l_orderkey", "l_linenumber", "l_partkey", op.percentage(F.col("l_discount"), zero).alias("p"), op.growth(F.col("l_extendedprice"), zero).alias("g"), op.area(F.col("l_quantity"), F.col("l_tax") - 0.02).alias("a"), op.stripping_ratio(F.col("l_extendedprice"), zero).alias("s"), op.productivity(F.col("l_quantity"), zero).alias("w"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("p.value", 8).alias("percentage"), F.round("g.value", 8).alias("growth"), F.round("a.value", 6).alias("area"), F.col("a.status").alias("area_status"), F.round("s.value", 8).alias("stripping"), F.round("w.value", 8).alias("productivity"), F.col("p.status").alias("status"))


_RATIOS = """WITH z AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 0.0::DOUBLE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN d <> 0 THEN l_discount / d * 100 END, 8) AS percentage, round(CASE WHEN d <> 0 THEN (l_extendedprice - d) / d * 100 END, 8) AS growth,
  round(CASE WHEN l_tax - 0.02::DOUBLE >= 0 THEN l_quantity * (l_tax - 0.02::DOUBLE) END, 6) AS area, CASE WHEN l_tax - 0.02::DOUBLE < 0 THEN 'negative_length' ELSE 'ok' END AS area_status,
  round(CASE WHEN d <> 0 THEN l_extendedprice / d END, 8) AS stripping, round(CASE WHEN d <> 0 THEN l_quantity / d END, 8) AS productivity,
  CASE WHEN d IS NULL THEN 'missing_input' WHEN d = 0 THEN 'zero_denominator' ELSE 'ok' END AS status FROM z"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").withColumn("amount", F.when(F.col("event_id") % 11 != 0, F.round("value", 2)))
    return op.period_over_period(e, "amount", "event_id", ("user_id",)).select("event_id", "user_id", F.round("difference", 6).alias("difference"), F.round("percent", 4).alias("percent"))


_SEQUENCE = """SELECT event_id, user_id, round(amount - previous, 6) AS difference, round(CASE WHEN previous <> 0 THEN (amount - previous) / previous * 100 END, 4) AS percent FROM (
  SELECT *, lag(amount) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM (SELECT *, round(value, 2) AS amount FROM events WHERE event_id % 11 <> 0 AND value IS NOT NULL)) WHERE previous IS NOT NULL"""


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = good(spark, sf_dir).select("record_id", "mine_id")
    ids = rows.where(F.col("mine_id").isNotNull()).groupBy("mine_id").agg(F.sort_array(F.collect_list("record_id")).alias("ids"))
    kinds = F.array(*map(F.lit, ("sum", "average", "minimum", "maximum", "standard_deviation", "productivity")))
    requests = ids.select(F.explode(kinds).alias("kind"), "mine_id", "ids").select(F.concat_ws(":", "kind", "mine_id").alias("request_id"), "kind", F.col("ids").alias("record_ids"), F.lit(None).cast("int").alias("years"))
    return op.calculate(requests, good(spark, sf_dir)).select("request_id", "kind", "status", F.round("value", 5).alias("value"), "n_inputs")


_CALCULATIONS = """, ids AS (SELECT DISTINCT record_id, mine_id, tonnes FROM good WHERE mine_id IS NOT NULL), k AS (SELECT unnest(['sum', 'average', 'minimum', 'maximum', 'standard_deviation', 'productivity']) AS kind)
SELECT kind || ':' || mine_id AS request_id, kind, CASE WHEN kind = 'productivity' THEN 'INSUFFICIENT_VERIFIED_DATA' ELSE 'OK' END AS status,
  round(CASE kind WHEN 'sum' THEN sum(tonnes)::DOUBLE WHEN 'average' THEN avg(tonnes::DOUBLE) WHEN 'minimum' THEN min(tonnes)::DOUBLE WHEN 'maximum' THEN max(tonnes)::DOUBLE WHEN 'standard_deviation' THEN stddev_pop(tonnes::DOUBLE) END, 5) AS value, count(*) AS n_inputs
FROM ids, k GROUP BY mine_id, kind"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.production_report(verified(spark, sf_dir)).withColumn("value", F.round("value", 3))


_REPORT = f""", y AS (SELECT year, sum(tonnes) AS value FROM good WHERE year IS NOT NULL GROUP BY 1), st AS (SELECT avg(value::DOUBLE) AS m, stddev_pop(value::DOUBLE) AS s FROM y),
c AS ({_CROSS})
SELECT 'by_state' AS section, coalesce(state, 'UNSPECIFIED') AS key, round(sum(tonnes)::DOUBLE, 3) AS value, count(*)::VARCHAR AS detail FROM good GROUP BY 2
UNION ALL SELECT 'by_year', coalesce(year::VARCHAR, 'UNSPECIFIED'), round(sum(tonnes)::DOUBLE, 3), count(*)::VARCHAR FROM good GROUP BY 2
UNION ALL SELECT 'checks', validation_type, count(*)::DOUBLE, NULL FROM c GROUP BY 2
UNION ALL SELECT 'anomalies', year::VARCHAR, round(CASE WHEN s > 0 THEN abs(value::DOUBLE - m) / s ELSE 0 END, 3), CASE WHEN s > 0 AND abs(value::DOUBLE - m) / s > 2 THEN 'ANOMALY' ELSE 'NORMAL' END FROM y, st"""


def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(good(spark, sf_dir).where("mine_id IS NOT NULL"), ["mine_id"], ["period", "record_id"]).select("mine_id", "period", "record_id")


QUERIES = {f"i07_production_by_{by}": _grouped(by) for by in op.GROUPS} | {
    "d01_verified_production": (verified_records, _sql("SELECT record_id, mine, state, company, period, year, commodity, unit, round(value::DOUBLE, 6) AS value, record_id AS provenance_id, verification_id::VARCHAR AS provenance_verification, verifier_id::VARCHAR AS provenance_verifier, NULL::VARCHAR AS provenance_page FROM verified")),
    "c02_filtered_production": (filtered, _sql("SELECT record_id, state, year, commodity FROM verified WHERE year BETWEEN 1996 AND 1999 AND state ILIKE 'nation_1%' AND commodity ILIKE 'economy'")),
    "d16_only_record_ids": (by_record_ids, _sql("SELECT record_id, mine_id FROM verified WHERE record_id IN (SELECT record_id FROM production WHERE mine_id % 5 = 0)")),
    "i01_normalized_units": (normalized, _NORMALIZED),
    "i02_converted_units": (converted, _CONVERTED),
    "i03_extraction_units": (extraction_units, _EXTRACTION_UNITS),
    "i05_production_issues": (issues, _ISSUES),
    "i16_issue_checks": (issue_counts, f"SELECT issue AS validation_type, CASE WHEN issue LIKE 'MISSING_%' THEN 'WARNING' ELSE 'ERROR' END AS severity, CASE WHEN issue LIKE 'MISSING_%' THEN 'REVIEW_REQUIRED' ELSE 'FAILED' END AS status, count(*) AS n FROM ({_ISSUES}) GROUP BY 1, 2, 3"),
    "i06_count_verified": (count_verified, _sql("SELECT year, count(*) AS n FROM verified GROUP BY 1")),
    "i09_yearly": (observations, _sql("SELECT year, round(sum(tonnes)::DOUBLE, 6) AS value, count(*) AS record_count FROM good WHERE year IS NOT NULL GROUP BY 1")),
    "i10_trend_changes": (changes, _sql(f", {_BY_MINE} SELECT mine_id, from_year, year AS to_year, round((value - before)::DOUBLE, 6) AS change, round(CASE WHEN before <> 0 THEN (value - before)::DOUBLE / before::DOUBLE * 100 END, 4) AS change_percent FROM (SELECT *, lag(year) OVER w AS from_year, lag(value) OVER w AS before FROM by_mine WINDOW w AS (PARTITION BY mine_id ORDER BY year)) WHERE from_year IS NOT NULL")),
    "i11_cagr": (cagr, _sql(f", {_BY_MINE} SELECT mine_id, min(year) AS first_year, max(year) AS last_year, round(CASE WHEN max(year) > min(year) AND arg_min(value, year) > 0 THEN (pow(arg_max(value, year)::DOUBLE / arg_min(value, year)::DOUBLE, 1.0 / (max(year) - min(year))) - 1) * 100 END, 6) AS cagr_percent FROM by_mine GROUP BY 1")),
    "i12_statistics": (statistics, _sql("SELECT commodity, count(tonnes) AS n, round(sum(tonnes)::DOUBLE, 3) AS sum, round(avg(tonnes::DOUBLE), 3) AS mean, round(median(tonnes::DOUBLE), 3) AS median, round(min(tonnes)::DOUBLE, 3) AS min, round(max(tonnes)::DOUBLE, 3) AS max, round(stddev_pop(tonnes::DOUBLE), 3) AS stddev_pop, round(quantile_cont(tonnes::DOUBLE, 0.9), 3) AS percentile FROM good GROUP BY 1")),
    "i13_anomalies_z_score": (_anomalies("z_score", 1.5), _sql(f", {_BY_MINE}, s AS (SELECT *, avg(value::DOUBLE) OVER w AS m, stddev_pop(value::DOUBLE) OVER w AS d FROM by_mine WINDOW w AS (PARTITION BY mine_id)) SELECT mine_id, year, round(CASE WHEN d > 0 THEN abs(value::DOUBLE - m) / d ELSE 0 END, 3) AS score, CASE WHEN d > 0 AND abs(value::DOUBLE - m) / d > 1.5 THEN 'ANOMALY' ELSE 'NORMAL' END AS anomaly FROM s")),
    "i14_anomalies_iqr": (_anomalies("iqr", 1.5), _sql(f", {_BY_MINE}, s AS (SELECT mine_id, quantile_cont(value::DOUBLE, 0.25) AS a, quantile_cont(value::DOUBLE, 0.75) AS b FROM by_mine GROUP BY 1) SELECT mine_id, year, round(greatest(a - 1.5 * (b - a) - value::DOUBLE, value::DOUBLE - b - 1.5 * (b - a), 0), 3) AS score, CASE WHEN greatest(a - 1.5 * (b - a) - value::DOUBLE, value::DOUBLE - b - 1.5 * (b - a), 0) > 0 THEN 'ANOMALY' ELSE 'NORMAL' END AS anomaly FROM by_mine JOIN s USING (mine_id)")),
    "i15_cross_source_checks": (cross_source, _sql(_CROSS)),
    "i17_contradictions": (contradictions, _sql(f", c AS ({_CROSS}) SELECT CASE WHEN count(*) FILTER (WHERE status = 'CONFLICT') > 0 THEN 'CONTRADICTIONS_FOUND' ELSE 'NO_CONTRADICTIONS' END AS status FROM c")),
    "i18_total_average": (totals, _sql("SELECT commodity, round(sum(tonnes)::DOUBLE, 6) AS total, round(avg(tonnes::DOUBLE), 3) AS average FROM good GROUP BY 1")),
    "i19_ratios": (ratios, _RATIOS),
    "i22_period_over_period": (sequence, _SEQUENCE),
    "i24_calculations": (calculations, _sql(_CALCULATIONS)),
    "i25_production_report": (report, _sql(_REPORT)),
    "m06_latest": (latest_period, _sql("SELECT mine_id, max(period) AS period, arg_max(record_id, period || '|' || record_id) AS record_id FROM good WHERE mine_id IS NOT NULL GROUP BY 1")),
}
