"""Monthly series of scores: month arithmetic, carried-forward standings, changes, lead pairs, correlation.

Months are whole numbers, year * 12 + month - 1, so that calendar offsets are subtractions. Null means that
there is no reading; it is never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import resampling
from stancelake.session import checkpointed


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_label(month: Column) -> Column:
    """YYYY-MM of a month index."""
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def minus_months(month: Column, n: int) -> Column:
    return (month - n).cast("int")


def monthly_mean(rows: DataFrame, month: str = "month", value: str = "score", least: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, month, mean and n of the months with at least `least` values."""
    return rows.groupBy(*keys, month).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= least)


def last_per_month(rows: DataFrame, member: str = "member", bank: str = "bank", month: str = "month", ts: str = "ts", id_col: str = "id", score: str = "score") -> DataFrame:
    """The last reading within each member's month; the id breaks ties of the time."""
    newest = F.max_by(F.col(score), F.struct(ts, id_col)).alias("score")
    return rows.groupBy(bank, member, month).agg(newest)


def standing_series(rows: DataFrame, **names: str) -> DataFrame:
    """bank, month, stance and members: the mean over members of what each last said in or before the month.

    The months of a bank run from its first to its last. Readings become intervals, each valid until the
    member's next, and only their borders are aggregated: a bank's sum changes where a member's reading
    changes. So the cost is the number of readings, not members times months, and no spine is joined. Sums are
    of decimals, so that they do not depend on their order.
    """
    last = last_per_month(rows, **names)
    by_member = Window.partitionBy("bank", "member").orderBy("month")
    # a new reading adds what it differs by from the member's one before, and one member if it is the first
    step = last.select(
        "bank", "month",
        (F.col("score").cast("decimal(18,10)") - F.coalesce(F.lag("score").over(by_member), F.lit(0.0)).cast("decimal(18,10)")).alias("change"),
        F.when(F.lag("month").over(by_member).isNull(), 1).otherwise(0).alias("joined"),
    )
    steps = step.groupBy("bank", "month").agg(F.sum("change").alias("change"), F.sum("joined").alias("joined"))
    so_far = Window.partitionBy("bank").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("bank").orderBy("month")
    levels = steps.select("bank", "month", F.sum("change").over(so_far).alias("total"), F.sum("joined").over(so_far).alias("members"), F.coalesce(F.lead("month").over(ahead), F.col("month") + 1).alias("until"))
    spread = levels.select("bank", F.explode(F.sequence("month", F.col("until") - 1)).alias("month"), "total", "members")
    return spread.select("bank", "month", (F.col("total").cast("double") / F.col("members")).alias("stance"), F.col("members").cast("long").alias("members"))


def with_change(series: DataFrame, n: int, key: str = "bank", month: str = "month", value: str = "stance", out: str | None = None) -> DataFrame:
    """Adds the change over exactly n months; null where that month has no value."""
    before = series.select(F.col(key).alias("k"), (F.col(month) + n).alias("m"), F.col(value).alias("v"))
    joined = series.join(before, (series[key] == before["k"]) & (series[month] == before["m"]), "left")
    return joined.withColumn(out or f"delta_{n}m", F.col(value) - F.col("v")).drop("k", "m", "v")


def corpus_band(rows: DataFrame, month: str = "month", score: str = "score") -> DataFrame:
    """month, mean, one population deviation below and above it, clamped to [-1, 1], and n."""
    mean, spread = F.avg(score), F.stddev_pop(score)
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return rows.groupBy(month).agg(mean.alias("mean"), clamp(mean - spread).alias("low"), clamp(mean + spread).alias("high"), F.count(score).alias("n"))


def lead_pairs(index: DataFrame, rates: DataFrame, horizons: tuple[int, ...] = (0, 3, 6)) -> DataFrame:
    """name, series, horizon, month, x, y: the index of a month and the rate's change that follows it.

    index: (name, month, x); rates: (series, month, value). Horizon 0 is the change from the month before to the
    month; horizon h is the change from the month to h months on. Months without both rates give no pair.
    """
    spans = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(0 if h else 1).alias("back"), F.lit(h).alias("ahead")) for h in horizons]))
    wanted = index.select("name", "month", "x", spans.alias("s")).select("name", "month", "x", "s.horizon", (F.col("month") - F.col("s.back")).alias("start"), (F.col("month") + F.col("s.ahead")).alias("stop"))
    first = rates.select("series", F.col("month").alias("start"), F.col("value").alias("before"))
    last = rates.select("series", F.col("month").alias("stop"), F.col("value").alias("after"))
    joined = wanted.join(first, "start").join(last, ["series", "stop"])
    return joined.select("name", "series", "horizon", "month", "x", (F.col("after") - F.col("before")).alias("y"))


def pearson(x: str = "x", y: str = "y", least: int = 3) -> Column:
    """Correlation as an aggregate; 0 with under `least` pairs or a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) < least, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0)))


def correlations(pairs: DataFrame, keys: tuple[str, ...] = ("name", "series", "horizon")) -> DataFrame:
    return pairs.groupBy(*keys).agg(pearson().alias("r"), F.count(F.lit(1)).alias("n"))


def block_length(n: int, horizon: int) -> int:
    """Months in a block: horizon + 1 or the cube root of n, at least 2, at most half of n."""
    return min(max(2, horizon + 1, round(n ** (1 / 3))), max(2, n // 2))


def block_bootstrap(pairs: DataFrame, draws: int = 10_000, seed: int = 0, alpha: float = 0.05, family: int | None = None) -> DataFrame:
    """name, series, horizon, r, low, high, n: a circular moving-block interval of the correlation of every cell.

    The tails are alpha / 2 over the family's size, the number of cells unless given. Under three pairs the interval is r
    itself, 0. A cell may be of any length: see resampling.
    """
    keys = ["name", "series", "horizon"]
    pairs = checkpointed(pairs)  # made once, read by all that follows
    cells = family or max(1, pairs.select(*keys).distinct().count())
    n = F.col("n_")
    block = F.least(F.greatest(F.lit(2), F.col("horizon") + 1, F.rint(F.pow(n, F.lit(1 / 3)))), F.greatest(F.lit(2), F.floor(n / 2)))
    found = resampling.intervals(pairs, keys, ["month"], block=block, draws=draws, seed=seed, tail=alpha / 2 / cells)
    return found.select(*keys, F.col("value").alias("r"), "low", "high", "n")


def paired_bootstrap(rows: DataFrame, key: str, x: str = "x", y: str = "y", order: str = "year", draws: int = 2_000, seed: int = 0, statistic: str = "r") -> DataFrame:
    """key, value, low, high: an i.i.d. interval of the correlation (r) or the slope of y on x in each group.

    Pairs are drawn from the order of `order`, so that a seed means the same draws everywhere; a group may be of any
    length: see resampling.
    """
    found = resampling.intervals(checkpointed(rows.select(key, order, x, y)), [key], [order], x, y, statistic="correlation" if statistic == "r" else statistic, draws=draws, seed=seed, least=1, inward=1)
    return found.select(key, "value", "low", "high")


def least_squares(rows: DataFrame, x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, slope, intercept, r2, t and n of y on x; a constant x has slope 0."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    rest = F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy"))
    error = F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("sxx")))
    return sums.select(
        *keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.coalesce(F.try_divide(slope * F.col("sxy"), F.col("syy")), F.lit(0.0)).alias("r2"), F.coalesce(F.try_divide(slope, error), F.lit(0.0)).alias("t"), "n"
    )


def annual_changes(tone: DataFrame, rates: DataFrame) -> DataFrame:
    """year, tone, level, change, lead: a year's tone with the rate's level and its changes from the year before and to the next.

    A missing year before counts as no change (0.0); a missing next year is null.
    """
    before = rates.select((F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    after = rates.select((F.col("year") - 1).alias("year"), F.col("value").alias("after"))
    joined = tone.join(rates, "year").join(before, "year", "left").join(after, "year", "left")
    return joined.select("year", F.col("mean").alias("tone"), F.col("value").alias("level"), F.when(F.col("before").isNull(), 0.0).otherwise(F.col("value") - F.col("before")).alias("change"), (F.col("after") - F.col("value")).alias("lead"))


def latest_change(series: DataFrame, n: int = 3, key: str = "series", value: str = "value") -> DataFrame:
    """key, month, value, change of each series at its own last month; null where the month n before is missing."""
    last = series.groupBy(key).agg(F.max("month").alias("month"))
    now = series.join(last, [key, "month"])
    before = series.select(F.col(key).alias("k"), (F.col("month") + n).alias("m"), F.col(value).alias("before"))
    joined = now.join(before, (now[key] == before["k"]) & (now["month"] == before["m"]), "left")
    return joined.select(key, "month", value, (F.col(value) - F.col("before")).alias("change"))


def divergence(tone_change: Column, rate_change_bp: Column, tone_flat: float = 0.05, rate_flat: float = 5.0) -> dict[str, Column]:
    """tone_direction, rate_direction and aligned of a tone change and a rate change in basis points; aligned is null without both."""
    side = lambda x, band: F.when(F.abs(x) <= band, 0).otherwise(F.signum(x).cast("int"))
    word = lambda x, band, up, down: F.when(x.isNull(), "not enough history").when(x > band, up).when(x < -band, down).otherwise("little changed")
    aligned = F.when(tone_change.isNotNull() & rate_change_bp.isNotNull(), side(tone_change, tone_flat) == side(rate_change_bp, rate_flat))
    return {"tone_direction": word(tone_change, tone_flat, "more hawkish", "more dovish"), "rate_direction": word(rate_change_bp, rate_flat, "repricing higher", "repricing lower"), "aligned": aligned}


# The sentences of the comparison.
NO_HISTORY = "Not enough recent Federal Reserve history to compare the tone trend with market repricing over the last quarter."
TOGETHER = ": the platform's read and market pricing are moving together."
APART = ": the platform reads the committee differently from how the market is pricing the path."


def divergence_sentence(tone_change: Column, rate_change_bp: Column, tone_direction: Column, aligned: Column) -> Column:
    """One line of prose: what tone did, what the rate did, and whether they agree."""
    tone = F.format_string("Fed communication is %s (%+.2f over the quarter)", tone_direction, tone_change)
    rate = F.format_string("the 2-year yield has %s %.0fbp", F.when(rate_change_bp > 0, "risen").otherwise("fallen"), F.abs(rate_change_bp))
    said = F.when(aligned, F.concat(tone, F.lit(" and "), rate, F.lit(TOGETHER))).otherwise(F.concat(tone, F.lit(" while "), rate, F.lit(APART)))
    return F.when(aligned.isNull(), NO_HISTORY).otherwise(said)


def rate_months(rates: DataFrame, index: DataFrame) -> DataFrame:
    """Rate months within the months of the index, each once: what both have is what a chart of both spans."""
    span = index.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    return rates.join(F.broadcast(span), F.col("month").between(F.col("first"), F.col("last"))).select("month").distinct()


def span_union(rates: DataFrame, index: DataFrame) -> DataFrame:
    """first, last, months: of the index's months and the rate months within them together."""
    return rate_months(rates, index).union(index.select("month")).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count_distinct("month").alias("months"))


def with_history(index: DataFrame, least: int = 12) -> DataFrame:
    """The index as it is; fewer months than `least` are an error, as a chart of them would mislead."""
    months = index.select("month").distinct().limit(least).count()
    if months < least:
        raise errors.InsufficientData(f"{months} months with readings, {least} are needed")
    return index
