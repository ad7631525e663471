from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataframe.functions.units import EXTRACTION_UNITS, convert_units, normalize_units
from strataframe.operators import production as op


def units(spark, rows, registry=None):
    df = spark.createDataFrame(rows, "value string, unit string")
    out = normalize_units(df, rows=registry) if registry else normalize_units(df)
    return [(r.normalized_value, r.normalized_unit, r.unit_issue) for r in out.collect()]


def test_units(spark):
    got = units(spark, [("2", "million tonnes"), ("5", "MT"), ("5", " Mt "), ("1000", "kg"), (None, "t"), ("x", "t"), ("3", "furlong"), ("4", ""), ("7", "Rs")])
    assert got == [(Decimal(2000000), "t", None), (None, None, "AMBIGUOUS"), (Decimal(5000000), "t", None), (Decimal(1), "t", None), (None, None, "MISSING"), (None, None, "NOT_NUMERIC"), (None, None, "UNSUPPORTED"), (None, None, "MISSING"), (Decimal(7), "Rs", None)]


def test_two_registries(spark):
    assert units(spark, [("1", "kt"), ("1", "kg"), ("1", "m²")], EXTRACTION_UNITS) == [(Decimal(1000), "t", None), (None, None, "UNSUPPORTED"), (Decimal(1), "m2", None)]


def test_convert(spark):
    df = spark.createDataFrame([("12", "t", "Mt"), ("1", "t", "Rs"), ("1", "t", "?")], "value string, unit string, wanted string")
    got = [(None if r.converted is None else float(r.converted), r.convert_issue) for r in convert_units(df, "value", "unit", "wanted").collect()]
    assert got == [(12e-6, None), (None, "INCOMPATIBLE"), (None, "UNSUPPORTED")]


@pytest.mark.parametrize("period,year", [("2024-25", 2024), ("FY 1999", 1999), ("12345", None), ("17999", None), (None, None), ("2200", 2200), ("2201", None)])
def test_reporting_year(spark, period, year):
    assert spark.createDataFrame([(period,)], "p string").select(op.reporting_year(F.col("p"))).first()[0] == year


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (5.0,)], "v double")
    r = op.statistics(df, "v").first()
    assert (r.n, r["sum"], r["mean"], r["median"], r["percentile"]) == (3, 9.0, 3.0, 3.0, 3.0) and abs(r.stddev_pop - 1.63299) < 1e-4


def test_anomalies(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    assert [r.anomaly for r in op.anomalies(df, "v", "z_score", 1.0).orderBy("v").collect()] == ["NORMAL"] * 4 + ["ANOMALY"]
    assert [r.anomaly for r in op.anomalies(df, "v", "iqr", 1.5).orderBy("v").collect()] == ["NORMAL"] * 4 + ["ANOMALY"]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r.anomaly for r in op.anomalies(same, "v").collect()} == {"NORMAL"}
    with pytest.raises(ValueError):
        op.anomalies(df, "v", "guess")


def test_trend_and_cagr(spark):
    df = spark.createDataFrame([(2022, Decimal(10)), (2023, Decimal(20)), (2024, Decimal(40))], "year int, value decimal(38,9)")
    first = op.trend_changes(df).orderBy("from_year").first()
    assert (first.change, first.change_percent) == (Decimal(10), 100.0)
    two = spark.createDataFrame([(2020, Decimal(100)), (2022, Decimal(121))], "year int, value decimal(38,9)")
    assert abs(op.cagr(two).first().cagr_percent - 10) < 1e-9


def test_period_over_period(spark):
    df = spark.createDataFrame([(0, None), (1, 10.0), (2, 15.0), (3, 0.0)], "i int, v double")
    assert [(r.difference, r.percent) for r in op.period_over_period(df, "v", "i").orderBy("i").collect()] == [(5.0, 50.0), (-15.0, -100.0)]


def test_ratios(spark):
    df = spark.createDataFrame([(120.0, 100.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    got = [(r.g.value, r.g.status) for r in df.select(op.growth(F.col("a"), F.col("b")).alias("g")).collect()]
    assert got == [(20.0, "ok"), (None, "zero_denominator"), (None, "missing_input")]
    with pytest.raises(Exception, match="zero"):
        df.select(op.stripping_ratio(F.col("a"), F.col("b"), "raise")).collect()


def test_calculations(spark):
    rows = [("a", 1, None, "coal", 2020, "2020", Decimal(100)), ("b", 1, None, "coal", 2022, "2022", Decimal(121)), ("c", 2, None, "coal", 2022, "2022", Decimal(5))]
    prod = spark.createDataFrame(rows, "record_id string, mine_id int, project_id int, commodity string, year int, period string, tonnes decimal(29,9)")
    asked = [("1", "cagr", ["a", "b"], 2), ("2", "production_difference", ["a", "c"], None), ("3", "sum", ["a", "zz"], None), ("4", "sum", ["a", "b"], None), ("5", "growth_percentage", ["a"], None), ("6", "productivity", ["a"], None), ("7", "guess", ["a"], None), ("8", "production_share", ["a", "b"], None)]
    req = spark.createDataFrame(asked, "request_id string, kind string, record_ids array<string>, years int")
    got = {r.request_id: (r.status, None if r.value is None else round(r.value, 6)) for r in op.calculate(req, prod).collect()}
    assert got == {"1": ("OK", 10.0), "2": ("DIFFERENT_ENTITIES", None), "3": ("INSUFFICIENT_VERIFIED_DATA", None), "4": ("OK", 221.0), "5": ("NEEDS_TWO_RECORDS", None), "6": ("INSUFFICIENT_VERIFIED_DATA", None), "7": ("UNSUPPORTED_KIND", None), "8": ("OK", round(100 / 121 * 100, 6))}


def test_filters_refuse_contradictions(spark):
    with pytest.raises(ValueError):
        op.filter_production(spark.range(1), year=2020, year_from=2019)
    with pytest.raises(ValueError):
        op.filter_production(spark.range(1), year_from=2021, year_to=2020)


def test_requests_of_one_list_share_its_rows(spark):
    rows = [("a", 1, None, "coal", 2020, "2020", Decimal(100)), ("b", 1, None, "coal", 2022, "2022", Decimal(121)), ("c", 1, 7, "coal", 2022, None, Decimal(5))]
    prod = spark.createDataFrame(rows, "record_id string, mine_id int, project_id int, commodity string, year int, period string, tonnes decimal(29,9)")
    asked = [("1", "sum", ["a", "b", "a"], None), ("2", "sum", ["a", "b", "a"], None), ("3", "maximum", ["a", "b", "a"], None), ("4", "cagr", ["a", "b"], 1), ("5", "cagr", ["a", "b"], 2), ("6", "production_difference", ["a", "c"], None), ("7", "growth_percentage", ["c", "a"], None), ("8", "sum", [], None), ("9", "sum", None, None), ("10", "sum", [None], None)]
    req = spark.createDataFrame(asked, "request_id string, kind string, record_ids array<string>, years int")
    out = op.calculate(req, prod)
    got = {r.request_id: (r.status, None if r.value is None else round(r.value, 6), r.n_inputs) for r in out.collect()}
    assert got == {
        "1": ("OK", 221.0, 2), "2": ("OK", 221.0, 2), "3": ("OK", 121.0, 2), "4": ("OK", 21.0, 2), "5": ("OK", 10.0, 2), "6": ("DIFFERENT_ENTITIES", None, 2), "7": ("DIFFERENT_ENTITIES", None, 2),
        "8": ("INSUFFICIENT_VERIFIED_DATA", None, 0), "9": ("INSUFFICIENT_VERIFIED_DATA", None, 0), "10": ("INSUFFICIENT_VERIFIED_DATA", None, 0),
    }
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()  # rows are not repeated for each distinct count


def test_report_joins_the_records_once(spark):
    from strataframe.plans import production as plans

    out = plans.report(spark, "/root/testdata/sf0.001")
    assert "Relation [" not in out._jdf.queryExecution().optimizedPlan().toString()  # only the kept cells are read again
    sections = {r.section: r.n for r in out.groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert set(sections) == {"by_state", "by_year", "checks", "anomalies"}
