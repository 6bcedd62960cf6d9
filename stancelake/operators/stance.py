"""From labelled sentences to a document's stance, and from several scorers to one assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net(hawkish: Column, dovish: Column, relevant: Column) -> Column:
    """(hawkish - dovish) / relevant; 0 without relevant sentences."""
    return F.coalesce(F.try_divide((hawkish - dovish).cast("double"), relevant), F.lit(0.0))


def tone_label(hawkish: Column, dovish: Column, relevant: Column, neutral_band: float = 0.05, mixed_share: float = 0.25) -> Column:
    """neutral for none, mixed if both sides have their share, neutral inside the band, else the sign."""
    score = net(hawkish, dovish, relevant)
    return (
        F.when(relevant <= 0, "neutral")
        .when((hawkish >= mixed_share * relevant) & (dovish >= mixed_share * relevant), "mixed")
        .when(F.abs(score) < neutral_band, "neutral").when(score > 0, "hawkish").otherwise("dovish")
    )


def aggregate(labelled: DataFrame, key: str = "doc_id", label: str = "label", horizon: str = "horizon") -> DataFrame:
    """key, hawkish, dovish, neutral, relevant, net, forward_net, tone, directional_share, fired."""
    hawk, dove = F.col(label) == "hawkish", F.col(label) == "dovish"
    ahead = F.col(horizon) == "forward"
    counts = labelled.groupBy(key).agg(
        F.count_if(hawk).alias("hawkish"), F.count_if(dove).alias("dovish"), F.count(F.lit(1)).alias("relevant"),
        F.count_if(hawk & ahead).alias("h"), F.count_if(dove & ahead).alias("d"), F.count_if(ahead).alias("r"),
    )
    h, d, n = F.col("hawkish"), F.col("dovish"), F.col("relevant")
    return counts.select(
        key, h, d, (n - h - d).alias("neutral"), n, net(h, d, n).alias("net"), net(F.col("h"), F.col("d"), F.col("r")).alias("forward_net"),
        tone_label(h, d, n).alias("tone"), F.coalesce(F.try_divide((h + d).cast("double"), n), F.lit(0.0)).alias("directional_share"), (h + d > 0).alias("fired"),
    )


def by_aspect(labelled: DataFrame, key: str = "doc_id", label: str = "label", aspect: str = "aspect") -> DataFrame:
    """key, aspect, net, relevant of every aspect that occurs."""
    counts = labelled.groupBy(key, aspect).agg(F.count_if(F.col(label) == "hawkish").alias("h"), F.count_if(F.col(label) == "dovish").alias("d"), F.count(F.lit(1)).alias("relevant"))
    return counts.select(key, aspect, net(F.col("h"), F.col("d"), F.col("relevant")).alias("net"), "relevant")


def aspect_map(labelled: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """key, aspects: map of aspect to net."""
    rows = by_aspect(labelled, key, **names)
    aspect = names.get("aspect", "aspect")
    return rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(aspect, "net")))).alias("aspects"))


def side(score: Column, band: float = 0.05) -> Column:
    """1, -1 or 0 by the sign beyond a band."""
    return F.when(score > band, 1).when(score < -band, -1).otherwise(0)


def combine(headline: Column, structured: Column, classifier: Column, lexicon: Column, fired: Column, applies: Column, band: float = 0.05, review_at: float = 0.5) -> tuple[Column, Column]:
    """(uncertainty, needs_review): the share of cross-checks that contradict the headline.

    The structured net always counts, the classifier where it applies, the lexicon where it fired. With a
    neutral headline every directional check contradicts, with a directional one only the opposite side.
    """
    way = side(headline, band)

    def against(score: Column) -> Column:
        return F.when(way == 0, side(score, band) != 0).otherwise(side(score, band) == -way).cast("int")

    checks = F.lit(1) + applies.cast("int") + fired.cast("int")
    contradicting = against(structured) + F.when(applies, against(classifier)).otherwise(0) + F.when(fired, against(lexicon)).otherwise(0)
    uncertainty = contradicting / checks
    return uncertainty, uncertainty >= review_at
