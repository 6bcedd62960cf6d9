"""Read models over observations (bank, member, ts, id, score): boards, monitor, movers, feed, overview.

Every ordering has a last key that is unique, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import series

#: Bands of score that a bank is ranked by.
RANK_BANDS = 512

SORT_KEYS = ("stance", "delta_1m", "delta_3m", "committee", "bank")


def latest_per_member(rows: DataFrame) -> DataFrame:
    """bank, member, score and ts of each member's last reading."""
    newest = F.max_by(F.struct("score", "ts"), F.struct("ts", "id")).alias("newest")
    return rows.groupBy("bank", "member").agg(newest).select("bank", "member", "newest.score", "newest.ts")


def bank_boards(latest: DataFrame) -> DataFrame:
    """bank, mean, members, hawks, doves, divided: over the last reading of each member.

    A bank is divided if it has both camps and the smaller is at least half of the larger.
    """
    board = latest.groupBy("bank").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("score") > 0).alias("hawks"), F.count_if(F.col("score") < 0).alias("doves"))
    small, large = F.least("hawks", "doves"), F.greatest("hawks", "doves")
    return board.withColumn("divided", (small > 0) & (small * 2 >= large))


def ranked_members(latest: DataFrame, top: int | None = None) -> DataFrame:
    """Adds rank: each bank's members by score, highest first; `top` keeps that many of each bank.

    A bank is cut into bands of score that are ranked by themselves, behind the members in the bands above, so that
    no task orders a whole bank. Scores lie in [-1, 1]; null scores come last.
    """
    band = F.coalesce(F.floor((1 - F.col("score")) * (RANK_BANDS / 2)).cast("int"), F.lit(RANK_BANDS + 1))
    rows = latest.withColumn("band", band)
    above = Window.partitionBy("bank").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("bank", "band").agg(F.count(F.lit(1)).alias("here")).select("bank", "band", F.coalesce(F.sum("here").over(above), F.lit(0)).alias("above"))
    within = F.row_number().over(Window.partitionBy("bank", "band").orderBy(F.desc("score"), "member"))
    ranked = rows.join(bands, ["bank", "band"]).withColumn("rank", (F.col("above") + within).cast("int")).drop("band", "above")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def standings(rows: DataFrame) -> DataFrame:
    """bank, month, stance, members, delta_1m, delta_3m of every month of the standing series."""
    found = series.standing_series(rows)
    return series.with_change(series.with_change(found, 1), 3)


def policy_monitor(rows: DataFrame) -> DataFrame:
    """One row per bank: month and stance of its last month, changes over one and three months, camps, last_spoke.

    Stance and changes are shown, sorted and held against bands at two places; changes are those of the whole numbers.
    """
    two = lambda c: F.round(F.round(c, 9), 2).alias(c)
    months = standings(rows).select("bank", "month", two("stance"), two("delta_1m"), two("delta_3m"))
    last = months.groupBy("bank").agg(F.max_by(F.struct("month", "stance", "delta_1m", "delta_3m"), "month").alias("now")).select("bank", "now.*")
    latest = latest_per_member(rows)
    board = bank_boards(latest).select("bank", "members", "hawks", "doves", "divided")
    spoke = latest.groupBy("bank").agg(F.max("ts").alias("last_spoke"))
    return last.join(board, "bank").join(spoke, "bank")


def sorted_monitor(monitor: DataFrame, key: str = "stance") -> DataFrame:
    """Adds position by the key: largest first, nulls last; ties by number of members, then bank."""
    if key not in SORT_KEYS:
        raise errors.InvalidInput(f"unknown sort key {key!r}; one of {', '.join(SORT_KEYS)}")
    ties = [F.desc("members"), F.asc("bank")]
    by = {"committee": [F.desc(F.col("hawks") - F.col("doves")), F.desc("stance")], "bank": [F.asc("bank")]}.get(key, [F.desc_nulls_last(key)])
    return monitor.withColumn("position", F.row_number().over(Window.orderBy(*by, *ties)))


def direction(change: Column, band: float, up: str, down: str, flat: str) -> Column:
    """One of three words by a change and a band; null for none."""
    return F.when(change.isNull(), F.lit(None).cast("string")).when(change > band, up).when(change < -band, down).otherwise(flat)


def movers(monitor: DataFrame, delta: str = "delta_1m", band: float = 0.02, top: int = 6) -> DataFrame:
    """The banks whose change is over the band, largest first, at most `top`: bank, prev, stance, delta, side, word, width.

    A move extends a stance that was on its side of the band before, and turns to it otherwise. width is the
    percentage of the largest move.
    """
    moved = monitor.where(F.abs(delta) > band).orderBy(F.desc(F.abs(delta)), "bank").limit(top)
    prev = F.round(F.col("stance") - F.col(delta), 2)
    hawkish = F.col(delta) > 0
    word = F.when(hawkish, F.when(prev > band, "extending hawkish").otherwise("turning hawkish")).otherwise(F.when(prev < -band, "extending dovish").otherwise("turning dovish"))
    width = F.round(F.abs(delta) / F.max(F.abs(delta)).over(Window.partitionBy(F.lit(1))) * 100, 1)
    return moved.select("bank", prev.alias("prev"), "stance", F.col(delta).alias("delta"), F.when(hawkish, "hawk").otherwise("dove").alias("side"), word.alias("word"), width.alias("width"))


def kpi_extremes(monitor: DataFrame, delta: str = "delta_1m", band: float = 0.02) -> DataFrame:
    """One row: most hawkish and most dovish bank now, and the one that moved most, if any by more than the band. Ties: the first by name."""
    first = lambda x: F.struct(x.alias("x"), F.col("bank"))
    found = monitor.agg(F.min(first(-F.col("stance"))).alias("hawk"), F.min(first(F.col("stance"))).alias("dove"), F.min(F.when(F.abs(delta) > band, first(-F.abs(delta)))).alias("mover"))
    return found.select(F.col("hawk.bank").alias("most_hawkish"), (-F.col("hawk.x")).alias("highest"), F.col("dove.bank").alias("most_dovish"), F.col("dove.x").alias("lowest"), F.col("mover.bank").alias("moved_most"), (-F.col("mover.x")).alias("largest_move"))


def desk_read(rows: DataFrame, level_band: float = 0.08, drift_band: float = 0.05) -> DataFrame:
    """One row: the last month's mean, the pooled mean of up to three months with readings before it, the headline, and the banks at both ends.

    Ends are by the mean of the members' last readings; ties go to the first by name.
    """
    months = rows.groupBy("month").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))
    recent = months.orderBy(F.desc("month")).limit(4)
    newest = recent.agg(F.max("month").alias("newest"))
    now = F.col("month") == F.col("newest")
    share = lambda which: F.try_divide(F.sum(F.when(which, F.col("total"))), F.sum(F.when(which, F.col("n"))))
    read = recent.crossJoin(F.broadcast(newest)).agg(F.max("month").alias("month"), share(now).alias("now"), share(~now).alias("prior"))
    tone = direction(F.col("now"), level_band, "leaning hawkish", "leaning dovish", "broadly neutral")
    drift = F.coalesce(direction(F.col("now") - F.col("prior"), drift_band, " and drifting hawkish", " and drifting dovish", " and holding steady"), F.lit(""))
    ends = bank_boards(latest_per_member(rows)).agg(F.min(F.struct((-F.col("mean")).alias("x"), "bank")).alias("hawk"), F.min(F.struct(F.col("mean").alias("x"), "bank")).alias("dove"))
    headline = F.concat(F.lit("The central-bank chorus is "), tone, drift, F.lit("."))
    return read.where("month IS NOT NULL").crossJoin(F.broadcast(ends)).select("month", "now", "prior", headline.alias("headline"), F.col("hawk.bank").alias("hawk_bank"), F.col("dove.bank").alias("dove_bank"))


def recent_changes(rows: DataFrame, url: str = "url", top: int = 10) -> DataFrame:
    """The newest readings, one for each URL: with the change from the same member's reading before, rounded to 2."""
    newest = rows.groupBy(url).agg(F.max(F.struct("ts", "id")).alias("at")).orderBy(F.desc("at")).limit(top).select("at.ts", "at.id")
    chosen = rows.join(F.broadcast(newest), ["ts", "id"], "left_semi")
    # only the members of the few that are shown are looked back at
    others = rows.join(F.broadcast(chosen.select("member").distinct()), "member", "left_semi")
    by_member = Window.partitionBy("member").orderBy("ts", "id")
    changed = others.withColumn("change", F.round(F.col("score") - F.lag("score").over(by_member), 2))
    return changed.join(F.broadcast(newest), ["ts", "id"], "left_semi").select(*rows.columns, "change").orderBy(F.desc("ts"), F.desc("id"))


def disagrees(score: Column, other: Column, fired: Column, threshold: float = 0.5) -> Column:
    """Opposite signs, or a gap of at least the threshold, where the other scorer fired; one that abstained cannot disagree."""
    return fired & ((score * other < 0) | (F.abs(score - other) >= threshold))


def flagged_splits(rows: DataFrame, other: str = "lexicon_score", top: int = 8) -> DataFrame:
    """The reviewed readings with the widest gap between the two scorers: adds gap."""
    return rows.where("needs_review").withColumn("gap", F.abs(F.col("score") - F.col(other))).orderBy(F.desc("gap"), "id").limit(top)


def corpus_overview(rows: DataFrame) -> DataFrame:
    """One row of totals: speakers, speeches (by url), observations, flagged, banks, first and last time."""
    return rows.agg(F.count_distinct("member").alias("speakers"), F.count_distinct("url").alias("speeches"), F.count(F.lit(1)).alias("observations"), F.count_if("needs_review").alias("flagged"), F.count_distinct("bank").alias("banks"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def solo_speakers(names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name is that of one speaker: without a semicolon or comma."""
    return names.where(~F.col(name).rlike("[;,]"))


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the trimmed, lower-cased needle in any of the columns; an empty one matches all."""
    needle = needle.strip().lower()
    hit = F.lit(not needle)
    for column in columns:
        hit = hit | F.contains(F.lower(F.col(column)), F.lit(needle))
    return rows.where(hit)


def by_name(rows: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """Speakers in the order of their names, of equal names by id."""
    return rows.orderBy(name, id_col)


def in_time(rows: DataFrame, newest_first: bool = False, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """Observations oldest first, or speeches newest first; of one instant by id."""
    return rows.orderBy(F.desc(ts) if newest_first else F.asc(ts), id_col)


def known_bank(bank: str, banks: tuple[str, ...]) -> str:
    """The bank as it is; an unknown one is an error and never a default."""
    if bank not in banks:
        raise errors.InvalidInput(f"unknown bank {bank!r}; one of {', '.join(banks)}")
    return bank


def desk_label(name: Column) -> Column:
    """A name of an enumeration as prose: underscores become spaces, words begin in capitals."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def desk_code(bank: Column, codes: dict[str, str]) -> Column:
    """The short code of a bank; null for one that has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), bank)


def stance_bar(score: Column) -> dict[str, Column]:
    """What a bar of a score shows: its side, its width in percent of the whole axis, and the score in percent."""
    side = F.when(score > 0, "hawk").when(score < 0, "dove").otherwise("flat")
    return {"side": side, "width": F.round(F.least(F.abs(score), F.lit(1.0)) * 50, 1), "percent": F.round(score * 100).cast("int")}


def age_label(then: Column, now: Column) -> Column:
    """today, 5d ago, 3w ago, 4mo ago or 2y ago; times to come are today, null is null."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("int")
    ago = lambda n, unit: F.concat(n.cast("int").cast("string"), F.lit(f"{unit} ago"))
    return F.when(days <= 0, "today").when(days < 14, ago(days, "d")).when(days < 60, ago(F.floor(days / 7), "w")).when(days < 365, ago(F.floor(days / 30), "mo")).when(days.isNotNull(), ago(F.floor(days / 365), "y"))
