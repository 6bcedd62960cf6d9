"""Queries that join each event to the nearest row in time of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import asof, scan
from stancelake.plans.registry import register
from stancelake.session import table


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return rows if kind is None else rows.where(F.col("event_type") == kind).select("event_id", "ts")


@register("event_last_order", """WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, o_orderkey AS order_id, o_orderdate AS ordered FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def event_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's newest order before it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    found = asof.as_of(_events(spark, sf_dir), orders, "ts", "o_orderdate", {"user_id": "o_custkey"}, tie="o_orderkey")
    return found.select("event_id", F.col("match.o_orderkey").alias("order_id"), F.col("match.o_orderdate").alias("ordered"))


@register("event_newest_order", """WITH o AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, o_orderkey AS order_id, o_orderdate AS ordered FROM events e ASOF LEFT JOIN o ON e.ts >= o.o_orderdate""")
def event_newest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the newest order of anyone before it: all rows are of one key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    found = asof.as_of(_events(spark, sf_dir), orders, "ts", "o_orderdate", tie="o_orderkey")
    return found.select("event_id", F.col("match.o_orderkey").alias("order_id"), F.col("match.o_orderdate").alias("ordered"))


_KIND_SQL = "{k} AS (SELECT ts AS {k}_ts, {pick}(event_id) AS {k}_id FROM events WHERE event_type = '{name}' GROUP BY ts)"


@register("event_last_purchase", f"""WITH {_KIND_SQL.format(k='p', name='purchase', pick='max')}
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(p_ts) <= 3600000000 THEN p_id END AS purchase_id FROM events ASOF LEFT JOIN p ON ts > p_ts""")
def event_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last purchase of anyone before it, an hour ago at most."""
    found = asof.as_of(_events(spark, sf_dir), _events(spark, sf_dir, "purchase"), "ts", "ts", tie="event_id", strict=True, within=3600)
    return found.select("event_id", F.col("match.event_id").alias("purchase_id"))


@register("event_next_error", f"""WITH {_KIND_SQL.format(k='n', name='error', pick='min')}
SELECT event_id, n_id AS error_id FROM events ASOF LEFT JOIN n ON ts < n_ts""")
def event_next_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the first error of anyone after it."""
    found = asof.as_of(_events(spark, sf_dir), _events(spark, sf_dir, "error"), "ts", "ts", tie="event_id", direction="forward", strict=True)
    return found.select("event_id", F.col("match.event_id").alias("error_id"))


@register("event_nearest_signup", f"""WITH {_KIND_SQL.format(k='b', name='signup', pick='max')}, {_KIND_SQL.format(k='a', name='signup', pick='min')},
j AS (SELECT event_id, ts, b_ts, b_id FROM events ASOF LEFT JOIN b ON ts >= b_ts), m AS (SELECT * FROM j ASOF LEFT JOIN a ON ts <= a_ts)
SELECT event_id, CASE WHEN a_ts IS NULL OR epoch_us(ts) - epoch_us(b_ts) <= epoch_us(a_ts) - epoch_us(ts) THEN b_id ELSE a_id END AS signup_id FROM m""")
def event_nearest_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the nearest signup of anyone."""
    found = asof.as_of(_events(spark, sf_dir), _events(spark, sf_dir, "signup"), "ts", "ts", tie="event_id", direction="nearest")
    return found.select("event_id", F.col("match.event_id").alias("signup_id"))


@register("event_places", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, round(sum(CAST(round(value, 4) AS DECIMAL(18, 4))) OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE, 4) + 0.0 AS so_far FROM events")
def event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's number and running value among those of its type, of which there are five."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.round("value", 4).cast("decimal(18,4)").alias("value"))
    found = scan.running(rows, ["event_type"], [F.col("ts"), F.col("event_id")], {"place": F.lit(1).cast("long"), "so_far": F.col("value")})
    return found.select("event_id", "event_type", "place", (F.round(F.col("so_far").cast("double"), 4) + 0.0).alias("so_far"))
