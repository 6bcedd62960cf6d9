"""Streams of readings as keyed state: late, repeated and silent members, batches that are run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import snapshots
from stancelake.streaming import standing, stateful

DAY = datetime.datetime(2024, 5, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


@pytest.fixture()
def session(spark):
    other = spark.newSession()
    for name, value in stateful.STORE.items():
        other.conf.set(name, value)
    return other


SCHEMA = "member string, ts timestamp, id long, score double"


def arrive(session, folder, rows, name):
    session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / name))


def run(session, tmp_path, **how):
    rows = session.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    stateful.keep(stateful.changes(rows, **how), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    return {r["member"]: (r["score"], r["id"], r["readings"]) for r in stateful.standings(session, str(tmp_path / "t")).collect()}


FIRST = [("a", at(1), 1, 0.1), ("a", at(5), 2, 0.2), ("b", at(4), 3, 0.3), (None, at(4), 4, 1.0), ("b", None, 5, 1.0), ("b", at(4), 6, None)]
SECOND = [("a", at(5), 2, 0.2), ("a", at(3), 7, 0.7), ("b", at(4), 8, 0.8), ("c", at(6), 9, 0.9), ("c", at(6), 9, 0.9)]


def test_late_and_repeated_readings_equal_the_batch_result(session, tmp_path):
    folder = tmp_path / "in"
    arrive(session, folder, FIRST, "1")
    assert run(session, tmp_path, late="3 hours") == {"a": (0.2, 2, 2), "b": (0.3, 3, 1)}
    arrive(session, folder, SECOND, "2")
    got = run(session, tmp_path, late="3 hours")
    # as of all distinct rows at once: a late reading counts, a repeated one does not, ties go to the greater id
    rows = session.createDataFrame(FIRST + SECOND, SCHEMA).na.drop().distinct()
    want = {r["member"]: (r["score"], r["id"], r["readings"]) for r in rows.groupBy("member").agg(F.max_by("score", F.struct("ts", "id")).alias("score"), F.max_by("id", F.struct("ts", "id")).alias("id"), F.count("*").alias("readings")).collect()}
    assert got == want == {"a": (0.2, 2, 3), "b": (0.8, 8, 2), "c": (0.9, 9, 1)}
    # only changes were added, and earlier snapshots stay
    tables = snapshots.Tables(session, str(tmp_path / "t"))
    first = min(tables.numbers())
    assert {r["member"]: r["readings"] for r in stateful.standings(session, str(tmp_path / "t"), first).collect()} == {"a": 2, "b": 1}
    arrive(session, folder, [("c", at(7), 10, -0.5)], "3")
    before = tables.read(stateful.TABLE).count()
    run(session, tmp_path, late="3 hours")
    assert tables.read(stateful.TABLE).count() == before + 1
    assert run(session, tmp_path, late="3 hours")["c"] == (-0.5, 10, 2)  # nothing new: nothing is added


def test_readings_behind_the_watermark_are_dropped(session, tmp_path):
    arrive(session, tmp_path / "in", [("a", at(10), 1, 0.1)], "1")
    run(session, tmp_path, late="2 hours")
    arrive(session, tmp_path / "in", [("a", at(7), 2, 0.2), ("a", at(9), 3, 0.3)], "2")
    assert run(session, tmp_path, late="2 hours") == {"a": (0.1, 1, 2)}


def test_silent_members_are_forgotten(session, tmp_path):
    arrive(session, tmp_path / "in", [("a", at(0), 1, 0.1), ("b", at(0), 2, 0.2)], "1")
    assert set(run(session, tmp_path, late="1 hour", forget_ms=3_600_000)) == {"a", "b"}
    arrive(session, tmp_path / "in", [("b", at(9), 3, 0.3)], "2")
    run(session, tmp_path, late="1 hour", forget_ms=3_600_000)
    arrive(session, tmp_path / "in", [("b", at(9), 4, 0.4)], "3")
    got = run(session, tmp_path, late="1 hour", forget_ms=3_600_000)
    assert "a" not in got and got["b"][0] == 0.4


def test_a_batch_that_is_run_again_adds_nothing(session, tmp_path):
    arrive(session, tmp_path / "in", FIRST, "1")
    want = run(session, tmp_path)
    commits = tmp_path / "c" / "commits"
    for file in commits.iterdir():  # as if the driver was lost before the batch was marked as done
        file.unlink()
    assert run(session, tmp_path) == want
    assert len(snapshots.Tables(session, str(tmp_path / "t")).snapshot().tables[stateful.TABLE]) <= 2


def test_changes_are_put_together(session, tmp_path):
    for k in range(4):
        arrive(session, tmp_path / "in", [("a", at(k), k, k / 10), (f"m{k}", at(k), 100 + k, 0.5)], str(k))
        rows = session.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        stateful.keep(stateful.changes(rows), str(tmp_path / "t"), str(tmp_path / "c"), compact_every=3).awaitTermination()
    tables = snapshots.Tables(session, str(tmp_path / "t"))
    assert len(tables.snapshot().tables[stateful.TABLE]) < 4
    got = {r["member"]: (r["score"], r["readings"]) for r in stateful.standings(session, str(tmp_path / "t")).collect()}
    assert got == {"a": (0.3, 4), "m0": (0.5, 1), "m1": (0.5, 1), "m2": (0.5, 1), "m3": (0.5, 1)}


def test_the_state_store_is_asked_for(spark, tmp_path):
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(errors.InvalidInput, match="RocksDB"):
        stateful.changes(rows)


def test_a_complete_result_is_switched_whole(spark, tmp_path):
    for k in range(2):
        arrive(spark, tmp_path / "in", [("a", at(k), k, k / 10)], str(k))
        rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        standing.stream_table(standing.standing(rows), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [r["readings"] for r in standing.stream_result(spark, str(tmp_path / "t")).collect()] == [2]
    assert [r["readings"] for r in standing.stream_result(spark, str(tmp_path / "t"), 1).collect()] == [1]
