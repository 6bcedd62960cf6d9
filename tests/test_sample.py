"""The seeded sample: whole at sizes that adaptive execution would deal anew, with ties, nulls and few rows."""

import random

import pytest
from pyspark.sql import functions as F

from stancelake.operators import evaluation


def test_all_drawn_rows_of_300_000_wide_ones(spark):
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("key"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"wide{k}") for k in range(6)])
    got = sorted(r["key"] for r in evaluation.sampled(rows, 1000, "key", 11).collect())
    keys = sorted(k * 7919 % 300_007 for k in range(300_000))
    assert got == sorted(keys[p] for p in random.Random(11).sample(range(300_000), 1000))


@pytest.mark.parametrize("k", [0, 5, 37, 200])
def test_ties_nulls_and_all(spark, k):
    values = [None] * 20 + [1] * 60 + [2**60 + 1, 2**60 + 3] + [5] * 18
    rows = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "key long, n int").repartition(5)
    got = evaluation.sampled(rows, k, "key", 3).collect()
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    places = random.Random(3).sample(range(100), min(k, 100))
    assert sorted((r["key"] for r in got), key=str) == sorted((ordered[p] for p in places), key=str)
    assert len({r["n"] for r in got}) == len(got)  # no row twice
    assert sorted(map(tuple, evaluation.sampled(rows.repartition(2), k, "key", 3).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_rows_that_are_equal_in_everything_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "x")] * 50 + [("b", "y")] * 2, "value_ string, nth_ string")
    assert evaluation.sampled(rows, 51, "value_", 1).count() == 51
    assert evaluation.sampled(rows.limit(0), 5, "value_").count() == 0
