"""The grams in most texts without a shuffle of all grams: summaries bound which can be among them, those are counted.

A task keeps a bounded number of counters (Misra and Gries 1982, in steps): where there are twice as many it takes the size of
the largest that must go from all, and remembers how much it took. So a count is short by what was taken at most, and
so is a gram that has no counter. Summaries of tasks add up, and so does what was taken. Grams whose count and all that
was taken fall short of the last wanted one are ruled out; the others are counted in a second pass. If the
summaries were too small to rule enough out, it is done again with larger ones: results are exact.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancelake.functions import text
from stancelake.session import checkpointed

#: Counters of a task at first.
COUNTERS = 1 << 16


class Summary:
    """Counters of texts' distinct grams, and how much any count may be short."""

    def __init__(self, most: int):
        self.most, self.counts, self.taken = most, collections.Counter(), 0

    def add(self, grams: set[str]) -> None:
        self.counts.update(grams)
        if len(self.counts) > 2 * self.most:
            self._cut()

    def _cut(self) -> None:
        sizes = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        step = int(np.partition(sizes, len(sizes) - self.most - 1)[len(sizes) - self.most - 1])
        self.taken += step
        self.counts = collections.Counter({g: n - step for g, n in self.counts.items() if n > step})

    def rows(self) -> pa.RecordBatch:
        """The counters, and behind them a row without gram for what was taken."""
        if len(self.counts) > self.most:
            self._cut()
        return pa.RecordBatch.from_arrays([pa.array([*self.counts, None], pa.string()), pa.array([*self.counts.values(), self.taken], pa.int64())], ["gram", "n"])


def _grams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[set[str]]:
    for batch in batches:
        for x in batch.column("text"):
            yield set(text.grams_of(x.as_py() or "", most))


def document_frequency(documents: DataFrame, wanted: int = 5000, least: int = 3, most: int = 2, text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """gram, df of the `wanted` grams in most texts, ties by the gram, of those in at least `least`; exact.

    Every row is a text; null is empty. If there are fewer such grams all are given. What is shuffled is the counters of the
    tasks, and twice as many in each further round.
    """
    rows = documents.select(F.col(text_col).alias("text"))
    while True:
        def summed(batches: Iterator[pa.RecordBatch], size: int = counters) -> Iterator[pa.RecordBatch]:
            summary = Summary(size)
            for grams in _grams(batches, most):
                summary.add(grams)
            yield summary.rows()

        found = checkpointed(rows.mapInArrow(summed, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
        taken = found.where("gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        kept = found.where("gram IS NOT NULL")
        last = kept.orderBy(F.desc("n")).limit(wanted).agg(F.min("n"), F.count(F.lit(1))).first()  # a few thousand rows
        bound = last[0] if last[1] == wanted else 0
        if taken == 0:
            exact = kept.select("gram", F.col("n").alias("df"))
            break
        if taken < bound:
            # what may be among the first: no more than counters that reach the bound less what was taken
            able = kept.where(F.col("n") + taken >= bound).select("gram")
            exact = _counted(rows, able, most, counters)
            break
        counters *= 4
    return exact.where(F.col("df") >= least).orderBy(F.desc("df"), "gram").limit(wanted)


def _counted(rows: DataFrame, able: DataFrame, most: int, counters: int) -> DataFrame:
    """gram, df of the grams of `able`, which are sent to all tasks if they are not more than a task's counters."""
    few = able.limit(4 * counters + 1).toArrow().column("gram").to_pylist()
    if len(few) > 4 * counters:  # then they are joined
        words = text.tokens(F.col("text"))
        return rows.select(F.explode(F.array_distinct(text.ngrams(words, most))).alias("gram")).join(able, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: collections.Counter = collections.Counter()
        for grams in _grams(batches, most):
            counts.update(grams & sent.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    return rows.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("df"))


def vocabulary(documents: DataFrame, least: int = 3, wanted: int = 5000, most: int = 2, text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """gram, df, column: what features.vocabulary gives of the grams of all texts."""
    kept = document_frequency(documents, wanted, least, most, text_col, counters)
    return kept.withColumn("column", F.row_number().over(Window.orderBy("gram")) - 1)  # a few thousand rows
