"""The benchmark tables in the roles of the domain: observations, members, banks, rates.

A bank is a region and a member a customer of it; an order is an observation, its score four decimals of its
price in [-1, 1]. Line items give two monthly rates. The SQL of each is beside it, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import series
from stancelake.session import table

SCORE = "greatest(-1.0D, least(1.0D, floor((o_totalprice / 250000.0D - 1.0D) * 10000.0D) / 10000.0D))"
LEXICON = "greatest(-1.0D, least(1.0D, floor((o_orderkey % 2001 - 1000.0D) * 10.0D) / 10000.0D))"

OBSERVATIONS_SQL = """
o AS (SELECT o_orderkey AS id, o_custkey AS member, r_name AS bank, o_orderdate AS ts,
        CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month,
        greatest(-1.0::DOUBLE, least(1.0::DOUBLE, floor((o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE) * 10000.0::DOUBLE) / 10000.0::DOUBLE)) AS score,
        greatest(-1.0::DOUBLE, least(1.0::DOUBLE, floor((o_orderkey % 2001 - 1000.0::DOUBLE) * 10.0::DOUBLE) / 10000.0::DOUBLE)) AS lexicon_score,
        o_orderstatus = 'P' AS needs_review
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

RATES_SQL = """
rates AS (SELECT unnest(['administered', 'market']) AS series, month, unnest([a, m]) AS value FROM (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month, avg(l_discount) AS a, avg(l_extendedprice / 10000.0::DOUBLE) AS m FROM lineitem GROUP BY 1))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, member, bank, ts, month, score, lexicon_score, needs_review. The dimensions are small and joined first."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("bank"))
    members = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("member"), "bank")
    orders = table(spark, sf_dir, "orders")
    return orders.join(members, F.col("o_custkey") == F.col("member")).select(
        F.col("o_orderkey").alias("id"), "member", "bank", F.col("o_orderdate").alias("ts"), series.month_index(F.col("o_orderdate")).alias("month"),
        F.expr(SCORE).alias("score"), F.expr(LEXICON).alias("lexicon_score"), (F.col("o_orderstatus") == "P").alias("needs_review"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, month, value of the two monthly rates."""
    months = table(spark, sf_dir, "lineitem").groupBy(series.month_index(F.col("l_shipdate")).alias("month")).agg(F.avg("l_discount").alias("administered"), F.avg(F.col("l_extendedprice") / F.lit(10000.0)).alias("market"))
    return months.unpivot("month", ["administered", "market"], "series", "value").select("series", "month", "value")


def rounded(*names: str) -> list:
    """Columns rounded to nine places, so that sums in another order agree; adding zero makes minus zero plain."""
    return [(F.round(name, 9) + F.lit(0.0)).alias(name) for name in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({name}, 9) + 0.0 AS {name}" for name in names)
