"""Queries over gold and predicted labels."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import evaluation, features, heavy, training
from stancelake.plans.registry import register
from stancelake.plans.roles import rounded, rounded_sql
from stancelake.session import checkpointed, table, texts

_NAME = "CASE {0} WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' ELSE 'neutral' END"

ROWS_SQL = f"""e AS (SELECT l.doc_id, {_NAME.format('(quality + 2 * toxic) % 3')} AS gold, {_NAME.format('n_chars % 3')} AS first, {_NAME.format('(quality + n_chars % 2) % 3')} AS second,
  (n_chars % 997) / 996.0::DOUBLE AS confidence, (n_chars % 201 - 100) / 100.0::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gold, first, second, confidence, score: labels and formulas in the roles of gold and scorers."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    name = lambda x: F.when(x == 0, "hawkish").when(x == 1, "dovish").otherwise("neutral")
    n = F.col("n_chars")
    return joined.select("doc_id", name((F.col("quality") + 2 * F.col("toxic")) % 3).alias("gold"), name(n % 3).alias("first"), name((F.col("quality") + n % 2) % 3).alias("second"), ((n % 997) / F.lit(996.0)).alias("confidence"), ((n % 201 - 100) / F.lit(100.0)).alias("score"))


_SPINE = "c(class) AS (VALUES ('hawkish'), ('dovish'), ('neutral'))"


@register("confusion_matrix", f"WITH {ROWS_SQL}, {_SPINE} SELECT class AS gold, count(*) FILTER (first = 'hawkish') AS hawkish, count(*) FILTER (first = 'dovish') AS dovish, count(*) FILTER (first = 'neutral') AS neutral FROM c LEFT JOIN e ON gold = class GROUP BY class")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(rows(spark, sf_dir), predicted="first")


_METRICS = "count(*) FILTER (gold = class AND {0} = class) AS hit, count(*) FILTER ({0} = class) AS said, count(*) FILTER (gold = class) AS support"


@register("class_metrics", f"WITH {ROWS_SQL}, {_SPINE}, m AS (SELECT class, {_METRICS.format('first')} FROM c, e GROUP BY class) SELECT class, round(coalesce(hit / nullif(said, 0), 0), 9) AS precision, round(coalesce(hit / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 9) AS f1, support FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_metrics(rows(spark, sf_dir), predicted="first").select("class", *rounded("precision", "recall", "f1"), "support")


@register("accuracy_macro_f1", f"WITH {ROWS_SQL}, {_SPINE}, m AS (SELECT class, {_METRICS.format('first')} FROM c, e GROUP BY class) SELECT (SELECT round(avg((gold = first)::INT), 9) FROM e) AS accuracy, (SELECT count(*) FROM e) AS n, round(sum(coalesce(2 * hit / nullif(said + support, 0), 0)) / 3, 9) AS macro_f1 FROM m")
def accuracy_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scores(rows(spark, sf_dir), predicted="first").select(*rounded("accuracy"), "n", *rounded("macro_f1"))


@register("majority_baseline", f"WITH {ROWS_SQL} SELECT gold AS label, count(*) AS n, (SELECT count(*) FROM e) AS total FROM e GROUP BY gold ORDER BY n DESC, gold DESC LIMIT 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority(rows(spark, sf_dir))


@register("mcnemar_counts", f"""WITH {ROWS_SQL}, k AS (SELECT count(*) FILTER (first = gold AND second <> gold) AS only_first, count(*) FILTER (second = gold AND first <> gold) AS only_second, count(*) AS n FROM e)
SELECT only_first, only_second, n, round(pow(abs(only_first - only_second) - 1, 2) / (only_first + only_second), 9) AS chi2, round((only_first - only_second) / n, 9) AS gap FROM k""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mcnemar(rows(spark, sf_dir)).select("only_first", "only_second", "n", *rounded("chi2", "gap"))


# the tail of one degree of freedom, erfc(sqrt(chi2 / 2)), by Simpson's rule over ten units
_TAIL_SQL = "2 / sqrt(pi()) * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(sqrt(chi2 / 2) + i * 0.0025, 2))) * 0.0025 / 3 FROM range(0, 4001) r(i))"


@register("mcnemar_p", f"""WITH {ROWS_SQL}, k AS (SELECT count(*) FILTER (first = gold AND second <> gold) AS only_first, count(*) FILTER (second = gold AND first <> gold) AS only_second, count(*) AS n FROM e),
x AS (SELECT *, coalesce(pow(abs(only_first - only_second) - 1, 2) / nullif(only_first + only_second, 0), 0.0) AS chi2 FROM k)
SELECT only_first, only_second, n, round(chi2, 9) AS chi2, round({_TAIL_SQL}, 9) + 0.0 AS p, round((only_first - only_second) / n, 9) + 0.0 AS gap FROM x""")
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mcnemar_counts with the tail of its chi2."""
    return evaluation.with_p(evaluation.mcnemar(rows(spark, sf_dir))).select("only_first", "only_second", "n", *rounded("chi2", "p", "gap"))


@register("brier_score", f"WITH {ROWS_SQL} SELECT round(avg(pow(confidence - (gold = 'hawkish')::INT, 2) + pow((1 - confidence) / 4 - (gold = 'dovish')::INT, 2) + pow((1 - confidence) * 3 / 4 - (gold = 'neutral')::INT, 2)), 9) AS brier FROM e")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of what the confidence leaves goes to the second class."""
    left = 1 - F.col("confidence")
    shared = rows(spark, sf_dir).withColumn("dovish", left / 4).withColumn("neutral", left * 3 / 4)
    return evaluation.brier(shared, {"hawkish": "confidence", "dovish": "dovish", "neutral": "neutral"}).select(*rounded("brier"))


@register("accuracy_gap_ci")
def accuracy_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gap_interval(rows(spark, sf_dir))


_BINS = f"{ROWS_SQL}, b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS confidence, avg((gold = first)::INT) AS accuracy FROM e GROUP BY 1)"


@register("calibration_bins", f"WITH {_BINS} SELECT bin, n, {rounded_sql('confidence', 'accuracy')}, round(confidence - accuracy, 9) + 0.0 AS gap FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.calibration(rows(spark, sf_dir).withColumn("right", F.col("gold") == F.col("first")))
    return found.select("bin", "n", *rounded("confidence", "accuracy", "gap"))


@register("calibration_summary", f"WITH {_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 9) AS ece, round(max(abs(confidence - accuracy)), 9) AS mce, round(sum(n * (confidence - accuracy)) / sum(n), 9) + 0.0 AS signed_gap FROM b")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.calibration(rows(spark, sf_dir).withColumn("right", F.col("gold") == F.col("first")))
    return evaluation.calibration_summary(found).select(*rounded("ece", "mce", "signed_gap"))


@register("tau_search", f"""WITH {ROWS_SQL}, {_SPINE}, t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in evaluation.TAUS)}]) AS tau),
p AS (SELECT tau, gold, CASE WHEN score > tau THEN 'hawkish' WHEN score < -tau THEN 'dovish' ELSE 'neutral' END AS p FROM e, t),
m AS (SELECT tau, class, {_METRICS.format('p')} FROM p, c GROUP BY ALL), f AS (SELECT tau, sum(coalesce(2 * hit / nullif(said + support, 0), 0)) / 3 AS macro_f1 FROM m GROUP BY tau),
a AS (SELECT tau, avg((gold = p)::INT) AS accuracy FROM p GROUP BY tau)
SELECT tau, {rounded_sql('macro_f1', 'accuracy')}, tau = (SELECT tau FROM f ORDER BY round(macro_f1, 12) DESC, tau LIMIT 1) AS best FROM f JOIN a USING (tau)""")
def tau_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tau_search(rows(spark, sf_dir)).select("tau", *rounded("macro_f1", "accuracy"), "best")


@register("lexicon_means_by_class", f"WITH {ROWS_SQL} SELECT gold, round(avg(score), 9) + 0.0 AS mean, count(*) AS n FROM e GROUP BY gold")
def lexicon_means_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("gold").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")).select("gold", *rounded("mean"), "n")


#: Terms of the classifier's vocabulary.
TERMS = 5000


@register("classifier_train_eval")
def classifier_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on all of two thirds of the labelled documents and scores the rest."""
    gold = rows(spark, sf_dir).select("doc_id", F.col("gold").alias("label"))
    # the join moves all texts; it is done once and what it leaves is read by every pass
    documents = checkpointed(texts(spark, sf_dir, "doc_id", "text").join(gold.select("doc_id"), "doc_id", "left_semi"))
    terms, n = checkpointed(heavy.vocabulary(documents, wanted=TERMS)), documents.count()
    inside, outside = documents.where("doc_id % 3 <> 0"), documents.where("doc_id % 3 = 0")
    model = training.train(gold.where("doc_id % 3 <> 0"), features.tfidf(inside, terms=terms, n=n), TERMS)
    weights = features.tfidf(outside, terms=terms, n=n).join(F.broadcast(features.model_table(spark, model.coefficients)), "column")
    found = features.softmax_scores(outside, weights, {c: F.col(c) for c in features.CLASSES}, dict(zip(features.CLASSES, map(float, model.intercepts))))
    tried = found.join(gold.withColumnRenamed("label", "gold"), "doc_id")
    return evaluation.class_metrics(tried, predicted="label")


@register("classifier_folds", f"""WITH {ROWS_SQL} SELECT gold, count(*) AS held_out, true AS all_counted FROM e JOIN documents USING (doc_id) WHERE len(regexp_extract_all(lower(text), '[a-z'']+')) > 0 GROUP BY gold""")
def classifier_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion of three folds and two penalties, trained together on all labelled documents: each is held out once."""
    gold = rows(spark, sf_dir).select("doc_id", F.col("gold").alias("label"))
    _, _, counts = training.choose_penalty(texts(spark, sf_dir, "doc_id", "text"), gold, (1e-3, 1e-2), epochs=40, least=1)
    each = counts.groupBy("gold", "penalty").agg(F.sum("n").alias("n"))
    return each.groupBy("gold").agg(F.min("n").alias("held_out"), (F.min("n") == F.max("n")).alias("all_counted"))


#: A labelling sheet of this many rows.
SHEET, SHEET_SEED = 100, 7

# the places drawn of as many rows as the tables of each size have: a draw that does not depend on this library
_DRAWN = ", ".join(f"({n}, {place})" for n in (1_500, 15_000, 150_000) for place in random.Random(SHEET_SEED).sample(range(n), SHEET))


@register("deterministic_sample", f"""WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM o, n WHERE (n, place) IN (VALUES {_DRAWN})""")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelling sheet: rows of all orders at the places that a seed draws."""
    orders = table(spark, sf_dir, "orders")
    return evaluation.sampled(orders, SHEET, "o_orderkey", SHEET_SEED).select("o_orderkey", "o_custkey", "o_totalprice")
