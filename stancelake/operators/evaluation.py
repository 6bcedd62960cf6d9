"""Metrics of predicted against gold labels."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.operators import scan
from stancelake.session import checkpointed, unused

CLASSES = ("hawkish", "dovish", "neutral")

TAUS = tuple(round(0.05 * k, 2) for k in range(13))


def confusion(rows: DataFrame, classes: tuple[str, ...] = CLASSES, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """gold and one column of counts for each predicted class; a row for every class, zeros filled in."""
    spine = rows.sparkSession.createDataFrame([(c,) for c in classes], "gold string")
    counts = rows.groupBy(F.col(gold).alias("gold")).agg(*[F.count_if(F.col(predicted) == c).alias(c) for c in classes])
    return spine.join(counts, "gold", "left").fillna(0)


def class_metrics(rows: DataFrame, classes: tuple[str, ...] = CLASSES, gold: str = "gold", predicted: str = "predicted", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, class, precision, recall, f1, support; zero where a divisor is."""
    spine = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    is_gold, is_predicted = F.col(gold) == F.col("class"), F.col(predicted) == F.col("class")
    # three counts a row and class; combined before the shuffle
    counts = rows.select(*keys, gold, predicted, spine).groupBy(*keys, "class").agg(F.count_if(is_gold & is_predicted).alias("hit"), F.count_if(is_predicted).alias("said"), F.count_if(is_gold).alias("support"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(*keys, "class", share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(F.col("hit") * 2, F.col("said") + F.col("support")).alias("f1"), "support")


def scores(rows: DataFrame, classes: tuple[str, ...] = CLASSES, gold: str = "gold", predicted: str = "predicted", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, accuracy, macro_f1 and n; the divisor of the macro mean is always the number of classes."""
    per_class = class_metrics(rows, classes, gold, predicted, keys).groupBy(*keys).agg((F.sum("f1") / len(classes)).alias("macro_f1"))
    overall = rows.groupBy(*keys).agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return overall.join(per_class, list(keys)) if keys else overall.crossJoin(per_class)


def majority(rows: DataFrame, gold: str = "gold") -> DataFrame:
    """The most common label and its share; ties by name."""
    return rows.groupBy(F.col(gold).alias("label")).count().agg(F.max_by("label", F.struct("count", F.col("label"))).alias("label"), F.max("count").alias("n"), F.sum("count").alias("total"))


def banded_label(score, tau: float | object):
    """hawkish, dovish or neutral of a score by a threshold; at the threshold it is neutral."""
    return F.when(score > tau, "hawkish").when(score < -tau, "dovish").otherwise("neutral")


def tau_search(rows: DataFrame, score: str = "score", gold: str = "gold", taus: tuple[float, ...] = TAUS, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """tau, macro_f1 and accuracy of every threshold of a small grid, and best: the first with the largest macro F1."""
    grid = F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau")
    tried = rows.select(gold, score, grid).withColumn("predicted", banded_label(F.col(score), F.col("tau")))
    found = scores(tried, classes, gold, "predicted", ("tau",))
    best = found.agg(F.min(F.struct((-F.round("macro_f1", 12)).alias("x"), "tau"))["tau"].alias("best_tau"))
    return found.crossJoin(F.broadcast(best)).select("tau", "macro_f1", "accuracy", (F.col("tau") == F.col("best_tau")).alias("best"))


def mcnemar(rows: DataFrame, gold: str = "gold", first: str = "first", second: str = "second") -> DataFrame:
    """only_first, only_second (right by one scorer alone), chi2 with continuity correction, and gap of the accuracies.

    The correction is not bounded: equal counts give 1 over their sum. Without such rows chi2 is 0.
    """
    a, b = F.col(first) == F.col(gold), F.col(second) == F.col(gold)
    counts = rows.agg(F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second"), F.count(F.lit(1)).alias("n"))
    apart = F.abs(F.col("only_first") - F.col("only_second"))
    chi2 = F.coalesce(F.try_divide(F.pow(apart - 1, 2), F.col("only_first") + F.col("only_second")), F.lit(0.0))
    return counts.select("only_first", "only_second", "n", chi2.alias("chi2"), F.coalesce(F.try_divide(F.col("only_first") - F.col("only_second"), F.col("n")), F.lit(0.0)).alias("gap"))


def chi2_p(chi2: float) -> float:
    """The upper tail of one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, chi2) / 2))


def with_p(found: DataFrame) -> DataFrame:
    """Adds p to the one row of mcnemar."""
    tail = F.pandas_udf(lambda x: x.map(chi2_p), "double")
    return found.withColumn("p", tail("chi2"))


def brier(rows: DataFrame, shares: dict[str, str], gold: str = "gold") -> DataFrame:
    """brier: the mean over rows of the summed squared distances of each class's share from whether it is the gold one."""
    apart = [F.pow(F.col(column) - (F.col(gold) == name).cast("double"), 2) for name, column in shares.items()]
    return rows.agg(F.avg(sum(apart[1:], apart[0])).alias("brier"))


def sampled(rows: DataFrame, k: int, order: str, seed: int = 0) -> DataFrame:
    """k rows drawn by a seed from those in the order of `order`, or all if there are no more.

    The draw is that of Python's Mersenne Twister over the row count, so it can be drawn again anywhere; k numbers are what
    the driver holds and what is broadcast. Rows that are equal in `order` follow by a hash of all their columns; of rows
    that are equal in everything any one is taken. Nulls come first. An empty table gives no rows.

    Values of the order are counted, running counts give the values that the drawn places fall on, and only rows of
    those values are numbered. No task has all rows or all of one value, and wide rows that are not drawn do not move.
    """
    n = rows.count()
    places = np.sort(np.array(random.Random(seed).sample(range(n), min(k, n)), np.int64))
    kind = rows.schema[order].dataType.simpleString()
    counts = rows.groupBy(F.col(order).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = scan.running(counts, [], [F.col("value").asc_nulls_first()], {"upto": F.col("n")})

    def drawn(batches):
        for batch in batches:
            n, ends = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "upto"))
            begins = ends - n
            first, last = np.searchsorted(places, begins), np.searchsorted(places, ends)
            of = np.repeat(np.arange(len(ends)), last - first)
            at = np.concatenate([places[a:b] for a, b in zip(first, last)]) if len(of) else np.zeros(0, np.int64)
            columns = [batch.column("value").take(pa.array(of, pa.int64())), pa.array(at - begins[of] + 1, pa.int64()), pa.array(n[of], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["value", "nth", "n"])

    hits = checkpointed(upto.mapInArrow(drawn, f"value {kind}, nth bigint, n bigint"))  # k rows
    value, nth, own = unused(rows, "value_"), unused(rows, "nth_"), unused(rows, "own_")
    hits = hits.select(F.col("value").alias(value), F.col("nth").alias(nth), F.col("n").alias(own))
    same = rows[order].eqNullSafe(F.col(value))
    alone = rows.join(F.broadcast(hits.where(f"{own} = 1").drop(nth, own)), same, "left_semi")
    many = rows.join(F.broadcast(hits.where(f"{own} > 1").select(value).distinct()), same, "left_semi")
    placed = scan.numbered(many, [order], [F.xxhash64(F.to_json(F.struct(*rows.columns)))], nth)
    wanted = hits.where(f"{own} > 1").select(value, F.col(nth).alias(own))
    return alone.unionByName(placed.join(F.broadcast(wanted), placed[order].eqNullSafe(F.col(value)) & (F.col(nth) == F.col(own)), "left_semi").select(*rows.columns))


def gap_interval(rows: DataFrame, gold: str = "gold", first: str = "first", second: str = "second", draws: int = 2_000, seed: int = 0) -> DataFrame:
    """gap, low, high: bootstrap of the accuracy gap.

    Only the three counts of a row's outcome matter, so draws are multinomial over them, and no rows move.
    """
    a, b = (F.col(first) == F.col(gold)).cast("int"), (F.col(second) == F.col(gold)).cast("int")
    counts = rows.agg(F.count_if(a > b).alias("up"), F.count_if(a < b).alias("down"), F.count_if(a == b).alias("even"))

    def resample(frames):
        for frame in frames:
            for up, down, even in frame.itertuples(index=False):
                n = up + down + even
                if not n:
                    continue
                drawn = np.random.default_rng(seed).multinomial(n, [up / n, down / n, even / n], draws)
                gaps = np.sort((drawn[:, 0] - drawn[:, 1]) / n)
                yield pd.DataFrame([[(up - down) / n, gaps[int(0.025 * draws)], gaps[int(0.975 * draws) - 1]]], columns=["gap", "low", "high"])

    return counts.mapInPandas(resample, "gap double, low double, high double")


def calibration(rows: DataFrame, confidence: str = "confidence", right: str = "right", bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean confidence, accuracy, gap of equal bins that have rows; the last holds 1."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    found = rows.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(right).cast("double")).alias("accuracy"))
    return found.withColumn("gap", F.col("confidence") - F.col("accuracy"))


def calibration_summary(found: DataFrame) -> DataFrame:
    """ece, mce and the signed gap of calibration bins."""
    n = F.sum("n")
    return found.agg((F.sum(F.col("n") * F.abs("gap")) / n).alias("ece"), F.max(F.abs("gap")).alias("mce"), (F.sum(F.col("n") * F.col("gap")) / n).alias("signed_gap"))
