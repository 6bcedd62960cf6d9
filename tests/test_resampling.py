"""Bootstrap by chunks: replicates laid out pair by pair, any chunk size and partitioning, laws of the draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.operators import resampling


def laid_out(n, size, block, draws, seed):
    """The places of every replicate, drawn chunk by chunk."""
    out = [[] for _ in range(draws)]
    upto = lambda c: min(n, c * size)
    chunks = -(-n // size)
    for kind, each, length in ((0, n // block, block), (1, int(n % block > 0), n % block)):
        for c in range(chunks if each else 0):
            count = resampling.draws_in(c, upto, chunks, each, draws, seed, 2 * kind)
            random = resampling._random(seed, 2 * kind + 1, c)
            for r in range(draws):
                for start in random.integers(0, upto(c + 1) - upto(c), int(count[r])):
                    out[r] += [(upto(c) + int(start) + j) % n for j in range(length)]
    return out


@pytest.mark.parametrize("n,size,block", [(3, 8, 1), (7, 3, 1), (20, 64, 4), (23, 6, 5), (50, 7, 7), (49, 16, 3)])
@pytest.mark.parametrize("statistic", resampling.STATISTICS)
def test_intervals_like_brute_force(spark, n, size, block, statistic):
    rng = np.random.default_rng(n)
    x, y = rng.normal(3, 1, n), rng.normal(size=n)
    rows = spark.createDataFrame([("k", i, float(x[i]), float(y[i])) for i in rng.permutation(n).tolist()], "key string, month int, x double, y double").repartition(3)
    draws = 64
    got = resampling.intervals(rows, ["key"], ["month"], block=block, statistic=statistic, draws=draws, seed=5, tail=0.1, chunk=size).first()
    places = laid_out(n, max(size, block), block, draws, 5)
    assert all(len(p) == n for p in places)

    def of(at):
        a, b = x[at], y[at]
        if statistic == "mean":
            return a.mean()
        spread = a.std() if statistic == "slope" else b.std()
        return ((a - a.mean()) * (b - b.mean())).mean() / (a.std() * spread) if a.std() * spread > 1e-15 else 0.0

    drawn = sorted(of(p) for p in places)
    assert (got["value"], got["low"], got["high"], got["n"]) == (pytest.approx(of(list(range(n)))), pytest.approx(drawn[6]), pytest.approx(drawn[57]), n)


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("key"), "id", F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    found = [resampling.intervals(rows.repartition(p), ["key"], ["id"], block=9, draws=50, chunk=400).orderBy("key").collect() for p in (1, 6)]
    for a, b in zip(*found):
        assert [a["low"], a["high"]] == [pytest.approx(b["low"], abs=1e-12), pytest.approx(b["high"], abs=1e-12)]


def test_draws_are_uniform_over_chunks():
    upto = lambda c: min(1000, c * 300)  # noqa: E731  three chunks of 300 and one of 100
    counts = np.stack([resampling.draws_in(c, upto, 4, 1000, 2000, 1, 0) for c in range(4)])
    assert (counts.sum(axis=0) == 1000).all()
    assert counts.mean(axis=1) == pytest.approx([300, 300, 300, 100], rel=0.01)
    assert counts.var(axis=1) == pytest.approx([210, 210, 210, 90], rel=0.15)
    assert abs(np.corrcoef(counts[0], counts[1])[0, 1] + 3 / 7) < 0.08


def test_few_rows_nulls_and_no_key(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, None), (None, 1, 1.0, 1.0), (None, 2, 2.0, 2.0), (None, 3, 3.0, 3.0)], "key string, t int, x double, y double")
    got = {r["key"]: (r["value"], r["low"], r["high"], r["n"]) for r in resampling.intervals(rows, ["key"], ["t"], draws=20).collect()}
    assert got["a"] == (0.0, 0.0, 0.0, 1) and got[None][0] == pytest.approx(1.0) and got[None][3] == 3
    one = resampling.intervals(rows, [], ["key", "t"], statistic="mean", draws=20).first()
    assert one["value"] == pytest.approx(1.8) and one["low"] < 1.8 < one["high"] and one["n"] == 5
    assert resampling.intervals(rows.limit(0), ["key"], ["t"]).count() == 0
