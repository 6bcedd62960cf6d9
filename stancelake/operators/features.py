"""N-gram counts, TF-IDF in long form, and a softmax classifier over it."""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake import errors
from stancelake.functions import text
from stancelake.operators import heavy

CLASSES = ("hawkish", "dovish", "neutral")


def term_frequency(documents: DataFrame, most: int = 2, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, gram, n: the runs of 1 to `most` words of each text."""
    words = documents.select(key, text.tokens(F.col(text_col)).alias("words"))
    return words.select(key, F.explode(text.ngrams(F.col("words"), most)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def grams(documents: DataFrame, most: int = 2, key: str = "doc_id", text_col: str = "text", each_once: bool = True) -> DataFrame:
    """key, gram: every run of 1 to `most` words of a text, once for each text if `each_once`, which takes no shuffle."""
    found = text.ngrams(text.tokens(F.col(text_col)), most)
    return documents.select(key, F.explode(F.array_distinct(found) if each_once else found).alias("gram"))


def document_frequency(counts: DataFrame, least: int = 3) -> DataFrame:
    """gram, df of the grams in at least `least` texts; `counts` has a row for each text and gram, as grams() gives."""
    return counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


#: Grams that a task counts before it passes the counts on.
COUNTED = 1 << 19


def gram_counts(documents: DataFrame, least: int = 3, most: int = 2, text_col: str = "text") -> DataFrame:
    """document_frequency(grams(documents)), counted in the tasks first: what is shuffled is a row for each gram of many texts.

    Every row is a text. A task keeps no more than about COUNTED grams at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: collections.Counter = collections.Counter()

        def out() -> Iterator[pa.RecordBatch]:
            grams, n = list(counts), list(counts.values())
            for a in range(0, len(grams), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(grams[a : a + (1 << 16)], pa.string()), pa.array(n[a : a + (1 << 16)], pa.int64())], ["gram", "n"])

        for batch in batches:
            for a, b in text.steps(batch.column(0)):
                for t in batch.column(0)[a:b].to_pylist():
                    counts.update(set(text.grams_of(t or "", most)))
                if len(counts) > COUNTED:
                    yield from out()
                    counts.clear()
        yield from out()

    return documents.select(text_col).mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def vocabulary(counts: DataFrame, least: int = 3, most: int = 5000) -> DataFrame:
    """gram, df, column: the `most` grams in most texts, ties by the gram; columns are in the order of the grams."""
    kept = document_frequency(counts, least).orderBy(F.desc("df"), "gram").limit(most)
    return kept.withColumn("column", F.row_number().over(Window.orderBy("gram")) - 1)


def idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(documents: DataFrame, most: int = 2, least: int = 3, features: int = 5000, key: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """key, gram, column, weight: (1 + ln tf) * idf, each text's weights of unit length.

    Only bounded summaries of document frequencies are shuffled. The vocabulary, of at most `features` rows, is made first
    and goes out to the texts, whose grams are counted and weighed where they are. Each row is a text of its own.
    """
    found = (heavy.vocabulary(documents, least, features, most, text_col) if terms is None else terms).collect()
    total = documents.count() if n is None else n
    column = {r["gram"]: (int(r["column"]), math.log((1 + total) / (1 + r["df"])) + 1) for r in found}

    sent = documents.sparkSession.sparkContext.broadcast(column)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in text.steps(texts):
                rows, grams, columns, found = [], [], [], []
                for row, t in enumerate(texts[a:b].to_pylist(), a):
                    for g, c, w in weighed(t or "", sent.value, most):
                        rows.append(row)
                        grams.append(g)
                        columns.append(c)
                        found.append(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(grams, pa.string()), pa.array(columns, pa.int32()), pa.array(found, pa.float64())], [key, "gram", "column", "weight"])

    # batches of keys and texts have few rows of output each, as many as a step has
    schema = T.StructType([documents.schema[key], T.StructField("gram", T.StringType()), T.StructField("column", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    return documents.select(key, text_col).mapInArrow(weights, schema)


def weighed(raw: str, column: dict[str, tuple[int, float]], most: int = 2) -> list[tuple[str, int, float]]:
    """(gram, column, weight) of the known grams of a text; `column` has the place and the idf of each."""
    counts = collections.Counter(g for g in text.grams_of(raw, most) if g in column)
    raws = [(g, column[g][0], (1 + math.log(k)) * column[g][1]) for g, k in counts.items()]
    length = math.sqrt(sum(w * w for _, _, w in raws))
    return [(g, c, w / length) for g, c, w in raws]


def weigh(raw: str, column: dict[str, tuple[int, float]], most: int = 2) -> list[dict]:
    """weighed, as rows of a struct."""
    return [{"gram": g, "column": c, "weight": w} for g, c, w in weighed(raw, column, most)]


def top_terms(weights: DataFrame, top: int = 5, key: str = "doc_id") -> DataFrame:
    """The heaviest grams of each text with their rank; ties by the gram."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "gram")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def softmax_scores(documents: DataFrame, weights: DataFrame, coefficients: dict[str, Column], intercepts: dict[str, float], key: str = "doc_id") -> DataFrame:
    """key, score (P(hawkish) - P(dovish)), confidence and label of every text; ties go to the class listed first.

    Coefficients are expressions over a weight's columns. Texts without known grams have the intercepts' own.
    """
    sums = weights.groupBy(key).agg(*[F.sum(F.col("weight") * c).alias(name) for name, c in coefficients.items()])
    rows = documents.select(key).join(sums, key, "left")
    logits = {name: F.coalesce(F.col(name), F.lit(0.0)) + intercepts[name] for name in coefficients}
    top = F.greatest(*logits.values())
    shares = {name: F.exp(z - top) for name, z in logits.items()}
    total = sum(shares.values(), F.lit(0.0))
    label = F.lit(list(logits)[-1])
    for name in reversed(list(logits)):
        label = F.when(logits[name] == top, name).otherwise(label)
    return rows.select(key, ((shares["hawkish"] - shares["dovish"]) / total).alias("score"), (F.lit(1.0) / total).alias("confidence"), label.alias("label"))


#: Labelled texts that are fitted on the driver, at most.
DRIVER_TEXTS = 20_000


def labelled_rows(rows: DataFrame, weights: DataFrame, most: int = DRIVER_TEXTS, label: str = "label", key: str = "doc_id", seed: int = 5) -> pd.DataFrame:
    """label, columns, weights (arrays) of at most `most` labelled texts, the documented bound of what is fitted: those of least hash, in the order of their keys."""
    sparse = weights.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("column", "weight"))).alias("terms"))
    chosen = rows.where(F.col(label).isNotNull()).select(key, label).dropDuplicates([key]).orderBy(F.xxhash64(F.lit(seed), key)).limit(most)
    found = chosen.join(sparse, key).select(key, label, F.col("terms.column").alias("columns"), F.col("terms.weight").alias("weights"))
    return found.orderBy(key).toPandas()


def _all_labelled(rows: DataFrame, weights: DataFrame, most: int, label: str = "label", key: str = "doc_id") -> pd.DataFrame:
    """labelled_rows of all labelled texts; more than `most` are an error."""
    if rows.where(F.col(label).isNotNull()).select(key).distinct().limit(most + 1).count() > most:
        raise errors.InvalidInput(f"more than {most} labelled texts; operators.training takes any number of them")
    return labelled_rows(rows, weights, most, label, key)


class _Sparse:
    """Rows of few columns as one run of entries; the last column is 1 in every row and carries the intercepts."""

    def __init__(self, columns: list, weights: list, n_columns: int):
        sizes = np.array([len(c) + 1 for c in columns])
        self.starts, self.n_columns = np.cumsum(sizes) - sizes, n_columns
        self.at = np.concatenate([np.append(c, n_columns) for c in columns]).astype(int)
        self.value = np.concatenate([np.append(w, 1.0) for w in weights])
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    def times(self, theta: np.ndarray) -> np.ndarray:
        return np.add.reduceat(theta[self.at] * self.value[:, None], self.starts)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.at, weights=g[self.row, k] * self.value, minlength=self.n_columns + 1) for k in range(g.shape[1])], axis=1)


def train_softmax(rows: DataFrame, weights: DataFrame, label: str = "label", key: str = "doc_id", penalty: float = 1e-3, epochs: int = 600, rate: float = 0.5, classes: tuple[str, ...] = CLASSES, most: int = DRIVER_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (columns, classes), intercepts): full-batch Adam, classes weighed by rarity, no penalty on intercepts.

    Fitted on the driver to all labelled texts, whose few weights each are kept sparse. More than `most` are an error: those are
    for training.train. A class without texts keeps 0.
    """
    return fit_softmax(_all_labelled(rows, weights, most, label, key), penalty, epochs, rate, classes, label)


def fit_softmax(known: pd.DataFrame, penalty: float, epochs: int, rate: float, classes: tuple[str, ...], label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros((1, len(classes))), np.zeros(len(classes))
    n_columns = max((max(c) for c in known["columns"] if len(c)), default=0) + 1
    x = _Sparse(list(known["columns"]), list(known["weights"]), n_columns)
    gold = (known[label].to_numpy()[:, None] == np.array(classes)).astype(float)
    rarity = len(gold) / (len(classes) * np.maximum(1, gold.sum(axis=0)))
    share = (gold @ rarity)[:, None] / len(gold)
    decay = np.full((n_columns + 1, 1), penalty)
    decay[-1] = 0
    theta = mean = square = np.zeros((n_columns + 1, len(classes)))
    for step in range(epochs):
        odds = x.times(theta)
        likely = np.exp(odds - odds.max(axis=1, keepdims=True))
        slope = x.back((likely / likely.sum(axis=1, keepdims=True) - gold) * share) + decay * theta
        mean, square = mean + (slope - mean) / 10, square + (slope * slope - square) / 1000
        unbiased = np.sqrt(square / (1 - 0.999 ** (step + 1))) + 1e-8
        theta = theta - rate / (1 - 0.9 ** (step + 1)) * mean / unbiased
    return theta[:-1], theta[-1]


def choose_penalty(documents: DataFrame, gold: DataFrame, grid: tuple[float, ...] = (3e-4, 1e-3, 3e-3), folds: int = 3, epochs: int = 400, rate: float = 0.5, features: int = 5000, least: int = 3, classes: tuple[str, ...] = CLASSES, key: str = "doc_id", text_col: str = "text", label: str = "label", seed: int = 0) -> tuple[float, dict[float, float]]:
    """The penalty with the best mean macro F1 over folds, the first of equals, and all means.

    Each fold has a vocabulary and frequencies of its own other texts only. Folds are by a hash of the key. More labelled texts
    than the driver's fit takes are an error: those are for training.choose_penalty.
    """
    rows = documents.select(key, text_col).join(gold.select(key, label), key).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)))
    found: dict[float, list[float]] = {p: [] for p in grid}
    for k in range(folds):
        fit, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        terms = vocabulary(grams(fit, 2, key, text_col), least, features)
        n = fit.count()
        inside, outside = (_all_labelled(part, tfidf(part, 2, key=key, text_col=text_col, terms=terms, n=n), DRIVER_TEXTS, label, key) for part in (fit, held))
        for p in grid:
            w, b = fit_softmax(inside, p, epochs, rate, classes, label)
            said = np.array([np.argmax(np.asarray(v) @ w[np.asarray(c, int)] + b) if len(c) and max(c) < len(w) else np.argmax(b + sum((v[i] * w[j] for i, j in enumerate(c) if j < len(w)), np.zeros(len(classes)))) for c, v in zip(outside["columns"], outside["weights"])], int)
            found[p].append(_macro_f1(outside[label].to_numpy(), np.array(classes)[said] if len(said) else np.array([]), classes))
    means = {p: float(np.mean(x)) for p, x in found.items()}
    return max(grid, key=lambda p: (means[p], -grid.index(p))), means


def _macro_f1(gold: np.ndarray, said: np.ndarray, classes: tuple[str, ...]) -> float:
    hits = [2 * ((gold == c) & (said == c)).sum() / max(1, (gold == c).sum() + (said == c).sum()) for c in classes]
    return float(np.mean(hits))


def model_table(spark, w: np.ndarray, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """column and one coefficient for each class, to join to weights."""
    return spark.createDataFrame(pd.DataFrame({"column": np.arange(len(w)), **{c: w[:, k] for k, c in enumerate(classes)}}))
