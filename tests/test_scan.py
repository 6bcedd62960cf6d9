"""Two-level scans and as-of joins against plain loops, on hot keys, ties, nulls and few or many ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import asof, scan


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_sums_and_last_values(spark, parts):
    random.seed(parts)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), k, random.choice([None, 1, 2, -7]), random.choice([None, f"v{k}"])) for k in range(300)]
    frame = spark.createDataFrame(rows, "key string, at int, x int, v string").repartition(7)
    got = scan.running(frame, ["key"], [F.col("at")], {"total": F.col("x"), "place": F.lit(1)}, {"last": F.col("v")}, parts)
    assert got.columns == ["key", "at", "x", "v", "total", "place", "last"]
    seen: dict = {}
    for r in sorted(got.collect(), key=lambda r: r["at"]):
        total, place, last = seen.get(r["key"], (0, 0, None))
        now = (total + (r["x"] or 0), place + 1, r["v"] if r["v"] is not None else last)
        assert (r["total"], r["place"], r["last"]) == now
        seen[r["key"]] = now
    assert sum(x[1] for x in seen.values()) == 300


def test_running_without_key_or_rows(spark):
    frame = spark.range(1000).select("id", F.col("id").alias("part_"), F.lit("1.25").cast("decimal(38,2)").alias("nth_"))
    got = scan.running(frame, [], [F.col("id").desc()], {"s": F.col("nth_").cast("decimal(20,2)")}, parts=9)
    assert all(float(r["s"]) == 1.25 * (1000 - r["id"]) for r in got.collect())
    assert scan.numbered(frame.limit(0), ["part_"], [F.col("id")]).count() == 0
    # a name that is taken is replaced
    assert sorted(r["id"] for r in scan.numbered(spark.range(50), [], [F.col("id").desc()], out="id").collect()) == list(range(1, 51))


def test_no_window_over_a_whole_key(spark):
    frame = spark.range(1000).select(F.lit("one").alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins such small tasks
    try:
        got = scan.running(frame, ["key"], [F.col("id")], {"n": F.lit(1)}, parts=8)
        sizes = [len(p) for p in got.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 700 and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def matched(left, right, direction, strict, within, ties="id"):
    out = {}
    for name, key, t in left:
        before = [(m, i) for i, k, m in right if None not in (k, m, key, t) and k == key and (m < t or m == t and not strict) and (within is None or t - m <= within)]
        after = [(m, i) for i, k, m in right if None not in (k, m, key, t) and k == key and (m > t or m == t and not strict) and (within is None or m - t <= within)]
        b, a = max(before, default=None), (min(after) if after else None)
        # of rows at one moment the backward match has the greatest id, the forward one the smallest
        pick = {"backward": b, "forward": a, "nearest": b if a is None or b is not None and t - b[0] <= a[0] - t else a}[direction]
        out[name] = None if pick is None else pick[1]
    return out


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("strict,within", [(False, None), (True, None), (False, 3), (True, 0)])
def test_as_of_like_brute_force(spark, direction, strict, within):
    random.seed(4)
    left = [(k, random.choice([1, 1, 1, 2, None]), random.choice([None, *range(40)])) for k in range(150)]
    right = [(k, random.choice([1, 1, 2, 3, None]), random.choice([None, *range(0, 40, 3)])) for k in range(40)]
    a = spark.createDataFrame(left, "name int, match int, t long")
    b = spark.createDataFrame(right, "id int, k int, t long")
    got = asof.as_of(a, b, "t", "t", {"match": "k"}, "id", direction, strict, within, out="found", parts=6)
    assert got.columns == ["name", "match", "t", "found"]
    assert {r["name"]: r["found"]["id"] if r["found"] else None for r in got.collect()} == matched(left, right, direction, strict, within)


def test_as_of_times_repeats_and_no_rows(spark):
    day = datetime.datetime(2020, 1, 1)
    a = spark.createDataFrame([(1, day + datetime.timedelta(seconds=10))] * 2, "id int, ts timestamp")
    b = spark.createDataFrame([(7, day)], "id int, ts timestamp")
    assert [r["match"]["id"] for r in asof.as_of(a, b, "ts", "ts", within=10).collect()] == [7, 7]
    assert [r["match"] for r in asof.as_of(a, b, "ts", "ts", within=9).collect()] == [None, None]
    assert [r["match"] for r in asof.as_of(a, b.limit(0), "ts", "ts", direction="nearest").collect()] == [None, None]
    assert asof.as_of(a.limit(0), b, "ts", "ts").count() == 0
    with pytest.raises(errors.InvalidInput):
        asof.as_of(a, b, "ts", "ts", direction="sideways")
