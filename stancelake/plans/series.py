"""Queries over monthly series: index, rates, lead pairs, correlation, divergence, yearly regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import series
from stancelake.plans.registry import register
from stancelake.plans.roles import OBSERVATIONS_SQL, RATES_SQL, observations, rates, rounded, rounded_sql

_INDEX_SQL = "idx AS (SELECT 'headline' AS name, month, avg(score) AS x FROM o GROUP BY month HAVING count(*) >= 3 UNION ALL SELECT 'lexicon', month, avg(lexicon_score) FROM o GROUP BY month HAVING count(*) >= 3)"
_PAIRS_SQL = f"""{OBSERVATIONS_SQL}, {RATES_SQL}, {_INDEX_SQL},
hz(horizon, back, ahead) AS (VALUES (0, 1, 0), (3, 0, 3), (6, 0, 6)),
pr AS (SELECT name, a.series, horizon, idx.month, x, b.value - a.value AS y FROM idx CROSS JOIN hz JOIN rates a ON a.month = idx.month - back JOIN rates b ON b.month = idx.month + ahead AND b.series = a.series)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, month, x: monthly means of both scores."""
    rows = observations(spark, sf_dir)
    both = [series.monthly_mean(rows, value=value).select(F.lit(name).alias("name"), "month", F.col("mean").alias("x")) for name, value in (("headline", "score"), ("lexicon", "lexicon_score"))]
    return both[0].unionByName(both[1])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lead_pairs(index(spark, sf_dir), rates(spark, sf_dir))


@register("monthly_index", f"WITH {OBSERVATIONS_SQL} SELECT month, format('{{:04d}}-{{:02d}}', month // 12, month % 12 + 1) AS label, round(avg(score), 9) + 0.0 AS mean, count(*) AS n FROM o GROUP BY month HAVING count(*) >= 3")
def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.monthly_mean(observations(spark, sf_dir))
    return found.select("month", series.month_label(F.col("month")).alias("label"), *rounded("mean"), "n")


@register("corpus_month_band", f"""WITH {OBSERVATIONS_SQL}, b AS (SELECT month, avg(score) AS mean, stddev_pop(score) AS s, count(*) AS n FROM o GROUP BY month)
SELECT month, round(mean, 9) + 0.0 AS mean, round(greatest(-1.0, least(1.0, mean - s)), 9) + 0.0 AS low, round(greatest(-1.0, least(1.0, mean + s)), 9) + 0.0 AS high, n FROM b""")
def corpus_month_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.corpus_band(observations(spark, sf_dir)).select("month", *rounded("mean", "low", "high"), "n")


@register("rate_monthly", f"WITH {RATES_SQL} SELECT series, month, {rounded_sql('value')} FROM rates")
def rate_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).select("series", "month", *rounded("value"))


@register("rate_annual", f"WITH {RATES_SQL} SELECT series, CAST(month // 12 AS INTEGER) AS year, round(avg(value), 9) + 0.0 AS value FROM rates GROUP BY ALL")
def rate_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).groupBy("series", F.floor(F.col("month") / 12).cast("int").alias("year")).agg(F.avg("value").alias("value")).select("series", "year", *rounded("value"))


@register("lead_pairs", f"WITH {_PAIRS_SQL} SELECT name, series, CAST(horizon AS INTEGER) AS horizon, month, {rounded_sql('x', 'y')} FROM pr")
def lead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("name", "series", "horizon", "month", *rounded("x", "y"))


@register("lead_correlations", f"WITH {_PAIRS_SQL} SELECT name, series, CAST(horizon AS INTEGER) AS horizon, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0.0) END, 9) + 0.0 AS r, count(*) AS n FROM pr GROUP BY ALL")
def lead_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlations(pairs(spark, sf_dir)).select("name", "series", "horizon", *rounded("r"), "n")


@register("lead_bootstrap_ci")
def lead_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.block_bootstrap(pairs(spark, sf_dir))


_SAID_SQL = f"""CASE WHEN aligned IS NULL THEN '{series.NO_HISTORY}' ELSE 'Fed communication is ' || tone_direction || ' (' || printf('%+.2f', tone_change) || ' over the quarter)' || CASE WHEN aligned THEN ' and ' ELSE ' while ' END
  || 'the 2-year yield has ' || CASE WHEN rate_change_bp > 0 THEN 'risen ' ELSE 'fallen ' END || printf('%.0f', abs(rate_change_bp)) || 'bp' || CASE WHEN aligned THEN '{series.TOGETHER.replace("'", "''")}' ELSE '{series.APART}' END END"""


@register("divergence_3m", f"""SELECT *, {_SAID_SQL} AS headline FROM (WITH {OBSERVATIONS_SQL}, {RATES_SQL},
i AS (SELECT month, avg(score) AS v FROM o GROUP BY month HAVING count(*) >= 3), m AS (SELECT month, value AS v FROM rates WHERE series = 'market'),
c AS (SELECT (SELECT v - (SELECT v FROM i WHERE month = (SELECT max(month) FROM i) - 3) FROM i ORDER BY month DESC LIMIT 1) AS t,
             (SELECT v - (SELECT v FROM m WHERE month = (SELECT max(month) FROM m) - 3) FROM m ORDER BY month DESC LIMIT 1) * 100 AS b)
SELECT round(t, 9) + 0.0 AS tone_change, round(b, 9) + 0.0 AS rate_change_bp,
  CASE WHEN t IS NULL THEN 'not enough history' WHEN t > 0.05 THEN 'more hawkish' WHEN t < -0.05 THEN 'more dovish' ELSE 'little changed' END AS tone_direction,
  CASE WHEN b IS NULL THEN 'not enough history' WHEN b > 5 THEN 'repricing higher' WHEN b < -5 THEN 'repricing lower' ELSE 'little changed' END AS rate_direction,
  CASE WHEN t IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(t) <= 0.05 THEN 0 ELSE sign(t) END = CASE WHEN abs(b) <= 5 THEN 0 ELSE sign(b) END END AS aligned FROM c)""")
def divergence_3m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series at its own last month, which may differ."""
    tone = series.monthly_mean(observations(spark, sf_dir)).select(F.lit("tone").alias("series"), "month", F.col("mean").alias("value"))
    market = rates(spark, sf_dir).where("series = 'market'")
    changes = series.latest_change(tone.unionByName(market), 3)
    both = changes.agg(F.max(F.when(F.col("series") == "tone", F.col("change"))).alias("tone_change"), (F.max(F.when(F.col("series") == "market", F.col("change"))) * 100).alias("rate_change_bp"))
    said = series.divergence(F.col("tone_change"), F.col("rate_change_bp"))
    shown = both.select(*rounded("tone_change", "rate_change_bp"), *[c.alias(name) for name, c in said.items()])
    return shown.withColumn("headline", series.divergence_sentence(F.col("tone_change"), F.col("rate_change_bp"), F.col("tone_direction"), F.col("aligned")))


_YEARS_SQL = f"""{OBSERVATIONS_SQL}, {RATES_SQL}, ty AS (SELECT CAST(month // 12 AS INTEGER) AS year, avg(score) AS mean FROM o GROUP BY 1 HAVING count(*) >= 8),
ry AS (SELECT CAST(month // 12 AS INTEGER) AS year, avg(value) AS value FROM rates WHERE series = 'market' GROUP BY 1),
ch AS (SELECT ty.year, mean AS tone, a.value AS level, coalesce(a.value - b.value, 0.0) AS change, c.value - a.value AS lead FROM ty JOIN ry a USING (year) LEFT JOIN ry b ON b.year = ty.year - 1 LEFT JOIN ry c ON c.year = ty.year + 1)"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.floor(F.col("month") / 12).cast("int").alias("year")
    tone = series.monthly_mean(observations(spark, sf_dir).select(year, "score"), month="year", least=8).select("year", "mean")
    market = rates(spark, sf_dir).where("series = 'market'").groupBy(year).agg(F.avg("value").alias("value"))
    return series.annual_changes(tone, market)


@register("annual_changes", f"WITH {_YEARS_SQL} SELECT year, {rounded_sql('tone', 'level', 'change', 'lead')} FROM ch")
def annual_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir).select("year", *rounded("tone", "level", "change", "lead"))


@register("annual_ols", f"""WITH {_YEARS_SQL}, f AS (SELECT count(*) AS n, regr_slope(change, tone) AS slope, regr_intercept(change, tone) AS intercept, regr_r2(change, tone) AS r2,
  regr_sxx(change, tone) AS sxx, regr_syy(change, tone) AS syy, regr_sxy(change, tone) AS sxy FROM ch)
SELECT {rounded_sql('slope', 'intercept', 'r2')}, round(slope / sqrt(greatest(0.0, syy - slope * sxy) / (n - 2) / sxx), 9) + 0.0 AS t, n FROM f""")
def annual_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.least_squares(_years(spark, sf_dir), "tone", "change").select(*rounded("slope", "intercept", "r2", "t"), "n")


@register("annual_bootstrap_ci")
def annual_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.paired_bootstrap(_years(spark, sf_dir).withColumn("cell", F.lit("change")), "cell", "tone", "change", statistic="slope")


@register("rate_span", f"WITH {OBSERVATIONS_SQL}, {RATES_SQL}, i AS (SELECT month FROM o GROUP BY month HAVING count(*) >= 3), u AS (SELECT month FROM i UNION SELECT month FROM rates WHERE month BETWEEN (SELECT min(month) FROM i) AND (SELECT max(month) FROM i)) SELECT min(month) AS first, max(month) AS last, count(*) AS months FROM u")
def rate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.span_union(rates(spark, sf_dir), series.with_history(series.monthly_mean(observations(spark, sf_dir))))
