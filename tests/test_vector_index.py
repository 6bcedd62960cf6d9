"""Exact search in blocks, the stored index and what it reads, and snapshots of tables."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import blocks, snapshots, vector_index


def brute(vectors, queries, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = {}
    for q, v in queries:
        near = sorted((round(float(1 - unit(v) @ unit(w)), 12), i) for i, w in vectors)[:k]
        out[q] = [i for _, i in near]
    return out


def listed(found):
    out = {}
    for r in found.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


def frame(spark, rows, kind="int"):
    return spark.createDataFrame(rows, f"id {kind}, v array<double>")


@pytest.mark.parametrize("held", [1000, 7, 1])
def test_block_search_like_brute_force(spark, held):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(150)]  # many ties and copies
    queries = [(i, v) for i, v in vectors if i % 5 == 0]
    got = blocks.nearest(frame(spark, vectors).repartition(6), frame(spark, queries).repartition(3), 4, held, parts=9)
    assert listed(got) == brute(vectors, queries, 4)


def test_block_search_of_odd_rows(spark):
    vectors = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), (None, [1.0, 0.0])], "string")
    for held in (100, 1):
        assert listed(blocks.nearest(vectors, vectors, 9, held)) == {"a": ["a", "b"], "b": ["a", "b"]}
        assert blocks.nearest(vectors.limit(0), vectors, 9, held).count() == 0
        assert blocks.nearest(vectors, vectors.limit(0), 9, held).count() == 0


def test_all_against_all_has_no_driver_loop(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows = frame(spark, vectors)
    got = blocks.nearest(rows, rows, 3, held=100, parts=12)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert listed(got) == brute(vectors, vectors, 3)


@pytest.fixture()
def stored(spark, tmp_path):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(20, 16))
    vectors = [(i, (middle[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(2000)] + [(2000, [0.0] * 16)]
    rows = spark.createDataFrame(vectors, "vec_id int, embedding array<double>")
    index = vector_index.ListIndex(spark, str(tmp_path / "index"))
    index.create(rows.where("vec_id % 3 = 0"), lists=16, most=300)
    index.append(rows.where("vec_id % 3 = 1"), "second")
    index.append(rows.where("vec_id % 3 = 2"), "third")
    return rows, index


def test_index_over_appends_has_recall(spark, stored):
    rows, index = stored
    exact = blocks.nearest(*[rows.selectExpr("vec_id id", "embedding v")] * 2, 5)
    for probes, least in ((6, 0.95), (16, 1.0)):
        found = index.search(rows, 5, probes)
        assert found.groupBy("query").count().where("count <> 5").isEmpty()
        both = found.join(exact.select("query", "id"), ["query", "id"])
        assert both.where("query <> 2000").count() >= least * 10_000
    assert index.count() == 2001 and index.count(1) == 667
    # a snapshot stays as it was
    assert index.search(rows.where("vec_id = 1"), 1, 16, snapshot=1).first()["id"] % 3 == 0
    with pytest.raises(errors.ImmutableRecord):
        index.append(rows.limit(1), "second")


def test_a_search_reads_only_probed_folders(spark, stored):
    rows, index = stored
    one = rows.where("vec_id = 30")
    found = index.search(one, 5, 2)
    want = [tuple(r) for r in found.orderBy("rank").collect()]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    centres, _ = index._centres()
    probed = set(one.select(vector_index.speeches.lists_of(F.col("embedding"), centres, 2)).first()[0]) | {vector_index.ZERO}
    broken = 0
    for folder, _, names in os.walk(index.tables.root):
        if "list=" in folder and int(folder.rsplit("list=", 1)[1]) not in probed:
            for name in names:
                if name.endswith(".parquet"):
                    broken += 1
                    os.remove(os.path.join(folder, f".{name}.crc"))
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(b"PAR1 not a table any more PAR1")
    assert broken > 10
    again = index.search(one, 5, 2)
    assert [tuple(r) for r in again.orderBy("rank").collect()] == want


def test_index_of_nothing_and_drift(spark, tmp_path):
    index = vector_index.ListIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(20)] + [(50, [0.0, 0.0]), (51, None), (None, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert index.search(rows, 3).count() == 0 and index.count() == 0
    with pytest.raises(errors.InsufficientData):
        index.append(rows, "b")
    with pytest.raises(errors.InsufficientData):
        index.create(rows.where("vec_id = 50"))
    index.create(rows, lists=2)
    assert index.count() == 21 and index.drift() == pytest.approx(1.0) and not index.refit(drifted=2.0)
    zero = listed(index.search(rows.where("vec_id = 50"), 2, 2))
    assert zero == {50: [0, 1]}
    index.append(spark.createDataFrame([(100 + k, [-1.0, 0.02 * k - 0.3]) for k in range(30)], "vec_id int, embedding array<double>"), "far")
    assert index.drift() > 100
    before = index.tables.snapshot().number
    assert index.refit(lists=2, drifted=2.0) and index.drift() == pytest.approx(1.0) and index.count() == 51
    assert index.count(before) == 51 and len(index.tables.snapshot().tables["lists"]) == 1
    assert index.tables.sweep() and index.count() == 51


# snapshots


def one(spark, n):
    return spark.createDataFrame([(n,)], "k int")


def keys(tables, name, number=None):
    return sorted(r["k"] for r in tables.read(name, number).collect())


def test_a_published_batch_cannot_be_changed(spark, tmp_path):
    tables = snapshots.Tables(spark, str(tmp_path))
    assert tables.snapshot() == snapshots.Snapshot(0, {})
    tables.publish({"a": one(spark, 1), "b": one(spark, 2)}, "x/y 1%")
    with pytest.raises(errors.ImmutableRecord):
        tables.publish({"a": one(spark, 9)}, "x/y 1%")
    assert keys(tables, "a") == [1] and keys(tables, "b") == [2] and tables.snapshot().number == 1
    with pytest.raises(errors.EntityNotFound):
        tables.read("c")
    with pytest.raises(errors.EntityNotFound):
        tables.read("a", 7)


def test_a_writer_that_fails_between_tables_leaves_nothing(spark, tmp_path):
    tables = snapshots.Tables(spark, str(tmp_path))
    bad = one(spark, 1).select(F.raise_error(F.lit("lost")).cast("int").alias("k"))
    with pytest.raises(Exception, match="lost"):
        tables.publish({"a": one(spark, 1), "b": bad}, "first")
    assert tables.numbers() == [] and os.path.isdir(tmp_path / "a")
    tables.publish({"a": one(spark, 2), "b": one(spark, 3)}, "first")
    assert keys(tables, "a") == [2] and keys(tables, "b") == [3]
    gone = tables.sweep()
    assert [name.split("/")[0] for name in gone] == ["a", "b"] and keys(tables, "a") == [2] and keys(tables, "b") == [3]


def test_two_writers_at_once_both_stay(spark, tmp_path):
    tables = snapshots.Tables(spark, str(tmp_path))
    heads = threading.Barrier(4)
    honest = tables.snapshot

    def together(number=None):
        found = honest(number)
        if number is None and threading.current_thread() is not threading.main_thread() and not getattr(threading.current_thread(), "met", False):
            threading.current_thread().met = True
            heads.wait(60)  # all have read the same head before any writes
        return found

    tables.snapshot = together
    failed = []

    def write(n):
        try:
            tables.publish({"a": one(spark, n), "b": one(spark, -n)}, f"batch{n % 3}")
        except errors.ImmutableRecord:
            failed.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    # 1 and 4 have one name: one of them is refused; nobody else is lost
    assert len(failed) == 1 and failed[0] in (1, 4)
    assert keys(tables, "a") == sorted({1, 2, 3, 4} - set(failed)) and keys(tables, "b") == sorted(-n for n in {1, 2, 3, 4} - set(failed))
    assert tables.numbers() == [1, 2, 3]
    assert len(keys(tables, "a", 1)) == 1 and len(keys(tables, "a", 2)) == 2


def test_replace_loses_nothing_that_came_meanwhile(spark, tmp_path):
    tables = snapshots.Tables(spark, str(tmp_path))
    base = tables.publish({"a": one(spark, 1), "b": one(spark, 1)}, "x")
    tables.publish({"a": one(spark, 2)}, "y")
    with pytest.raises(errors.ImmutableRecord):
        tables.replace({"a": one(spark, 5)}, "z", base)
    assert keys(tables, "a") == [1, 2]
    tables.replace({"a": one(spark, 5)}, "z", tables.snapshot())
    assert keys(tables, "a") == [5] and keys(tables, "b") == [1] and keys(tables, "a", 2) == [1, 2]


def test_rows_are_dealt_to_few_cells_of_bounded_groups(spark, monkeypatch):
    """A row goes to the cells of one side of a grid, not to a task for every few queries."""
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(900)]
    rows = frame(spark, vectors)
    got = blocks.nearest(rows, rows, 3, held=10)
    dealt = []
    monkeypatch.setattr(blocks, "in_cells", lambda v, q, *how: dealt.append((v.count(), q.count())) or got)
    blocks.nearest(rows, rows, 3, held=10)
    assert max(dealt[0]) <= 900 * 4  # 4 cores: 8 cells
    assert listed(got) == brute(vectors, vectors, 3)
    monkeypatch.undo()
    monkeypatch.setattr(blocks, "OF_CELL", 50)
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "COLUMNS", 11)
    assert listed(blocks.nearest(rows, rows, 3, held=10)) == brute(vectors, vectors, 3)


def test_lists_of_any_size_are_searched_whole(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(400)]  # copies in one list
    of = {i: 0 if i < 360 else i % 5 for i, _ in vectors}
    v = spark.createDataFrame([(of[i], i, x) for i, x in vectors], "list int, id int, v array<float>")
    q = spark.createDataFrame([(n, i, x) for i, x in vectors for n in {of[i], 2, 9}], "list int, id int, v array<float>")
    want = {i: brute([w for w in vectors if of[w[0]] in {of[i], 2, 9}], [(i, x)], 3)[i] for i, x in vectors}
    assert listed(blocks.in_lists(v, q, 3, parts=20)) == want
