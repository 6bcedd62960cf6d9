"""Rate series from CSV files of observation_date and one value column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.sources.archive import _there


def read_daily(spark: SparkSession, path: str, series: str) -> DataFrame:
    """series, date, value; `.` and empty values are left out, as are dates that are none. A missing file is BenchmarkUnavailable."""
    raw = _there(lambda: spark.read.csv(path, header=True, schema="observation_date string, value string", enforceSchema=True), path)
    rows = raw.select(F.lit(series).alias("series"), F.try_to_timestamp("observation_date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.expr("try_cast(value AS double)").alias("value"))
    return rows.where("date IS NOT NULL AND value IS NOT NULL")


def monthly(rows: DataFrame) -> DataFrame:
    """series, month, value: the mean of each month."""
    return rows.groupBy("series", (F.year("date") * 12 + F.month("date") - 1).cast("int").alias("month")).agg(F.avg("value").alias("value"))


def annual(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series", F.year("date").alias("year")).agg(F.avg("value").alias("value"))
