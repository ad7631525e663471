"""Units of the production records and of extracted quantities: two registries, kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_VERSION = "units-1.0"

#: Alias in lower case, base unit, dimension, factor to the base unit.
PRODUCTION_UNITS = [
    ("t", "t", "mass", "1"), ("tonne", "t", "mass", "1"), ("tonnes", "t", "mass", "1"), ("metric tonne", "t", "mass", "1"), ("metric tonnes", "t", "mass", "1"),
    ("kg", "t", "mass", "0.001"), ("kilogram", "t", "mass", "0.001"), ("kilograms", "t", "mass", "0.001"),
    ("mt", "t", "mass", "1000000"), ("million tonne", "t", "mass", "1000000"), ("million tonnes", "t", "mass", "1000000"), ("million metric tonnes", "t", "mass", "1000000"),
    ("rs", "Rs", "currency", "1"), ("inr", "Rs", "currency", "1"), ("rupee", "Rs", "currency", "1"), ("rupees", "Rs", "currency", "1"), ("₹", "Rs", "currency", "1"),
    ("million rs", "Rs", "currency", "1000000"), ("million inr", "Rs", "currency", "1000000"), ("million rupees", "Rs", "currency", "1000000"),
    ("man-shift", "man-shift", "labor", "1"), ("man shift", "man-shift", "labor", "1"), ("man-shifts", "man-shift", "labor", "1"), ("manshift", "man-shift", "labor", "1"), ("man days", "man-shift", "labor", "1"),
    ("%", "%", "percentage", "1"), ("percent", "%", "percentage", "1"), ("percentage", "%", "percentage", "1"),
]

#: Fixed values, as above, of the extraction rules.
EXTRACTION_UNITS = [
    ("t", "t", "mass", "1"), ("tonne", "t", "mass", "1"), ("tonnes", "t", "mass", "1"), ("metric tonne", "t", "mass", "1"), ("metric tonnes", "t", "mass", "1"),
    ("kt", "t", "mass", "1000"), ("kilotonne", "t", "mass", "1000"), ("kilotonnes", "t", "mass", "1000"),
    ("mt", "t", "mass", "1000000"), ("million tonne", "t", "mass", "1000000"), ("million tonnes", "t", "mass", "1000000"), ("million tons", "t", "mass", "1000000"),
    ("m", "m", "length", "1"), ("metre", "m", "length", "1"), ("metres", "m", "length", "1"), ("meter", "m", "length", "1"), ("meters", "m", "length", "1"),
    ("km", "m", "length", "1000"), ("kilometre", "m", "length", "1000"), ("kilometres", "m", "length", "1000"), ("kilometer", "m", "length", "1000"), ("kilometers", "m", "length", "1000"),
    ("ha", "m2", "area", "10000"), ("hectare", "m2", "area", "10000"), ("hectares", "m2", "area", "10000"),
    ("m2", "m2", "area", "1"), ("square metre", "m2", "area", "1"), ("square metres", "m2", "area", "1"), ("square meter", "m2", "area", "1"), ("square meters", "m2", "area", "1"), ("sqm", "m2", "area", "1"),
    ("%", "%", "percentage", "1"), ("percent", "%", "percentage", "1"), ("percentage", "%", "percentage", "1"),
    ("degree", "degree", "angle", "1"), ("degrees", "degree", "angle", "1"), ("deg", "degree", "angle", "1"), ("°", "degree", "angle", "1"),
]


def unit_table(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """``(alias, base_unit, dimension, factor)``: a few dozen rows, fit to broadcast."""
    return spark.createDataFrame(rows, "alias string, base_unit string, dimension string, factor string").withColumn("factor", F.col("factor").cast("decimal(18,6)"))


def ambiguous(unit: Column) -> Column:
    """``MT`` in any case but ``Mt`` may mean tonnes or million tonnes."""
    return (F.lower(F.trim(unit)) == "mt") & (F.trim(unit) != "Mt")


def _with_unit(df: DataFrame, unit: str, prefix: str, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    table = unit_table(df.sparkSession, rows).select(*[F.col(c).alias(f"{prefix}{c}") for c in ("alias", "base_unit", "dimension", "factor")])
    key = F.when(~ambiguous(F.col(unit)), F.regexp_replace(F.lower(F.trim(F.col(unit))), "²", "2"))
    return df.join(F.broadcast(table), key == F.col(f"{prefix}alias"), "left").drop(f"{prefix}alias")


def normalize_units(df: DataFrame, value: str = "value", unit: str = "unit", rows: list = PRODUCTION_UNITS) -> DataFrame:
    """Add ``normalized_value decimal(29,9)``, ``normalized_unit``, ``dimension``, ``conversion_rule`` and ``unit_issue``.

    ``unit_issue`` is null, ``MISSING``, ``NOT_NUMERIC``, ``AMBIGUOUS`` or ``UNSUPPORTED``; the others are then null.
    """
    number = F.expr(f"try_cast({value} AS decimal(20,6))")
    out = _with_unit(df, unit, "_u_", rows)
    issue = (
        F.when(F.col(value).isNull() | F.col(unit).isNull() | (F.trim(F.col(unit)) == ""), "MISSING")
        .when(number.isNull(), "NOT_NUMERIC")
        .when(ambiguous(F.col(unit)), "AMBIGUOUS")
        .when(F.col("_u_factor").isNull(), "UNSUPPORTED")
    )
    out = out.withColumn("unit_issue", issue)
    fine = F.col("unit_issue").isNull()
    return out.withColumns({
        "normalized_value": F.when(fine, (number * F.col("_u_factor")).cast("decimal(29,9)")),
        "normalized_unit": F.when(fine, F.col("_u_base_unit")),
        "dimension": F.when(fine, F.col("_u_dimension")),
        "conversion_rule": F.when(fine, F.lit(RULE_VERSION)),
    }).drop("_u_base_unit", "_u_dimension", "_u_factor")


def convert_units(df: DataFrame, value: str, unit: str, to: str, rows: list = PRODUCTION_UNITS) -> DataFrame:
    """Add ``converted decimal(30,12)`` and ``convert_issue`` (null, ``UNSUPPORTED`` or ``INCOMPATIBLE``)."""
    out = _with_unit(_with_unit(df, unit, "_f_", rows), to, "_t_", rows)
    issue = F.when(F.col("_f_factor").isNull() | F.col("_t_factor").isNull(), "UNSUPPORTED").when(F.col("_f_dimension") != F.col("_t_dimension"), "INCOMPATIBLE")
    out = out.withColumn("convert_issue", issue)
    amount = F.col(value).cast("decimal(20,6)") * F.col("_f_factor") / F.col("_t_factor")
    return out.withColumn("converted", F.when(F.col("convert_issue").isNull(), amount.cast("decimal(30,12)"))).drop(*[f"{p}{c}" for p in ("_f_", "_t_") for c in ("base_unit", "dimension", "factor")])
