"""Domain views over the supplied star schema, and the same views as SQL.

The supplied tables are not about mines: line items stand for production records, orders for verification records, suppliers
for mines, customers and parts for boreholes and coordinates. The SQL text repeats each derivation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("t", "kg", "Mt", "tonnes", "MT", "Rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("s_suppkey").alias("mine_id"), F.col("s_name").alias("canonical_name"), F.col("n_name").alias("state"),
        F.when(F.col("s_suppkey") % 4 != 0, F.col("r_name")).alias("operator"),
        (F.col("s_suppkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("s_suppkey") * 53 % 1600 / 10.0 - 80).alias("lat"),
        F.col("s_suppkey").alias("verification_id"), (F.col("s_suppkey") % 7).alias("verifier_id"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey < 50")
    return o.groupBy("o_orderkey").agg(F.min("o_custkey").alias("c")).select(
        F.col("o_orderkey").alias("project_id"), F.concat(F.lit("Project "), F.col("o_orderkey")).alias("project_name"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("c") % 10).alias("project_mine_id"), F.concat(F.lit("ORG"), F.col("o_orderkey") % 3).alias("organization"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("record_key"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 7).alias("verified_by"))


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    year = F.year("o_orderdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string")).alias("record_id"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_suppkey")).alias("mine_id"),
        F.when(F.col("l_orderkey") % 26 == 0, F.col("l_orderkey") % 50).alias("project_id"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit("FY")).otherwise(F.concat(year, F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).alias("period"),
        F.col("p_type").alias("commodity"),
        (F.col("l_quantity") * F.when(F.col("l_orderkey") % 201 == 0, -1).otherwise(1)).cast("decimal(20,6)").alias("value"),
        F.element_at(F.array(*map(F.lit, UNITS)), F.col("l_linenumber") % 6 + 1).alias("unit"),
        F.when(F.col("l_returnflag") == "R", "PENDING").otherwise("VERIFIED").alias("status"),
        F.col("o_orderkey").alias("verification_id"), (F.col("o_custkey") % 7 + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("verifier_id"),
    )


#: The views as SQL; a query takes the prefix and goes on with ``SELECT`` or further views.
SQL = """
mines AS (
  SELECT s_suppkey AS mine_id, s_name AS canonical_name, n_name AS state, CASE WHEN s_suppkey % 4 <> 0 THEN r_name END AS operator,
         s_suppkey * 37 % 3600 / 10.0 - 180 AS lon, s_suppkey * 53 % 1600 / 10.0 - 80 AS lat, s_suppkey AS verification_id, s_suppkey % 7 AS verifier_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
projects AS (
  SELECT o_orderkey AS project_id, 'Project ' || o_orderkey AS project_name, CASE WHEN o_orderkey % 5 <> 0 THEN min(o_custkey) % 10 END AS project_mine_id, 'ORG' || (o_orderkey % 3) AS organization
  FROM orders WHERE o_orderkey < 50 GROUP BY o_orderkey),
records AS (SELECT o_orderkey AS record_key, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 7 END AS verified_by FROM orders),
production AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS record_id,
         CASE WHEN l_orderkey % 13 <> 0 THEN l_suppkey END AS mine_id, CASE WHEN l_orderkey % 26 = 0 THEN l_orderkey % 50 END AS project_id,
         CASE WHEN l_orderkey % 97 = 0 THEN 'FY' ELSE year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') END AS period,
         p_type AS commodity, (l_quantity * CASE WHEN l_orderkey % 201 = 0 THEN -1 ELSE 1 END)::DECIMAL(20,6) AS value,
         ['t', 'kg', 'Mt', 'tonnes', 'MT', 'Rs'][l_linenumber % 6 + 1] AS unit, CASE WHEN l_returnflag = 'R' THEN 'PENDING' ELSE 'VERIFIED' END AS status,
         o_orderkey AS verification_id, o_custkey % 7 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS verifier_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""
