"""Line runs, exact clusters and lexical search: brute force, odd rows, and parts that must not show in results."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm import centroids, lexical, lines, q12_clusters

SPACE = " \t\n\x0b\f\r"


# lines


def kept_lines(texts, least, least_chars=1):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    split = [(t or "").split("\n") for t in texts]
    key = lambda line: line.strip(SPACE).translate(low)
    docs = collections.Counter(k for ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in docs.items() if n >= least and len(k) >= least_chars}
    return [(len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone)) for ls in split]


def odd_texts(n=60, seed=3):
    random.seed(seed)
    pool = ["Menu", " menu\t", "MENU", "Éa", "éa", "", "  ", "\x85x", "x", " y", "y", "long " * 50]
    texts = ["\n".join(random.choices(pool + [f"own {k}" for k in range(200)], k=random.randint(0, 12))) for _ in range(n)]
    return [None, "", "\n", "\n\n", "a\r\nb\r\n", *texts, texts[0], texts[0], "line\n" * 30_000]


@pytest.mark.parametrize("parts,width,least_chars,most_sent", [(1, 4, 1, 1 << 20), (7, 2, 1, 1 << 20), (7, 3, 1, 0), (5, 4, 3, 1), (3, 2, 0, 1 << 20)])
def test_lines_like_brute_force_in_any_batches(spark, tmp_path, parts, width, least_chars, most_sent):
    texts = odd_texts()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    runs = lines.Runs(spark, str(tmp_path / "runs"), least=5, least_chars=least_chars, width=width)
    for p in range(parts):
        runs.add(rows.where(F.col("doc_id") % parts == p))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.strip(rows, runs, most_sent=most_sent).collect()}
    assert [got[k] for k in range(len(texts))] == kept_lines(texts, 5, least_chars)
    assert sum(last - first for first, last in runs.runs) == parts
    runs.compact()
    assert runs.runs == [(0, parts)]
    runs.close(remove=True)


def test_runs_are_levelled_and_survive_what_is_unfinished(spark, tmp_path):
    folder = str(tmp_path / "runs")
    runs = lines.Runs(spark, folder, least=2, width=2)
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    for k in range(5):
        runs.add(batch("a\nb", f"c{k}"))
    assert runs.runs == [(0, 4), (4, 5)]
    # a is frequent in the run of the first four, so the fifth's run counts only its own line
    assert runs._read(4, 5).count() == 1
    (tmp_path / "runs" / f"run-5-6-{runs.buckets}").mkdir()  # a batch that was lost half-way
    runs.close()
    again = lines.Runs(spark, folder, least=2, width=2)
    assert again.runs == [(0, 4), (4, 5)]
    again.add(batch("c4", "z"))
    kept = lines.strip(batch("a\nc4\nc0\nz").selectExpr("1 doc_id", "text"), again).first()
    assert kept["kept"] == "c0\nz" and kept["n_dropped"] == 2
    again.close(remove=True)


def test_a_run_within_another_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "runs")
    runs = lines.Runs(spark, folder, least=3, width=10)
    for _ in range(2):
        runs.add(spark.createDataFrame([("a",)], "text string"))
    whole = runs._sum(runs.runs)
    runs._write(whole, 0, 2)  # compacted, but lost before the parts were removed
    runs.close()
    spark.sql(f"DROP TABLE {runs._table(0, 2)}")
    again = lines.Runs(spark, folder, least=3, width=10)
    assert again.runs == [(0, 2)] and again.frequent().count() == 0
    again.close(remove=True)


def test_joins_of_runs_move_nothing(spark, tmp_path):
    runs = lines.Runs(spark, str(tmp_path / "runs"), width=10)
    for k in range(3):
        runs.add(spark.createDataFrame([(f"a\nb{k}",)], "text string"))
    plan = runs._sum(runs.runs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close(remove=True)


def test_lines_of_clashing_names_and_no_rows(spark, tmp_path):
    runs = lines.Runs(spark, str(tmp_path / "runs"), least=2)
    rows = spark.createDataFrame([(1, "a\nb", 7), (None, "a", 8), (1, "a", 9)], "kept int, text string, n_lines int")
    assert lines.strip(rows, runs, id_col="kept").columns == ["kept_", "n_lines", "n_dropped", "kept"]
    runs.add(rows)
    runs.add(rows.limit(0))
    out = lines.strip(rows, runs, id_col="kept", carry=True).collect()
    assert sorted((r["row"]["n_lines"], r["kept"], r["n_lines"]) for r in out) == [(7, "b", 2), (8, "", 1), (9, "", 1)]
    assert lines.strip(rows.limit(0), runs, id_col="kept").count() == 0
    runs.close(remove=True)


# clusters


def exact_clusters(kept, first, rounds):
    now = [list(c) for c in first]
    nearest = lambda v: min(range(len(now)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, now[j])), j))
    for _ in range(rounds):
        of = [nearest(v) for v in kept]
        for j in range(len(now)):
            mine = [v for v, c in zip(kept, of) if c == j]
            if mine:
                now[j] = [sum(x) // len(mine) for x in zip(*mine)]
    of = [nearest(v) for v in kept]
    return now, of, [sum((a - b) ** 2 for a, b in zip(v, now[j])) for v, j in zip(kept, of)]


def test_screening_is_exact_where_distances_are_close():
    rng = np.random.default_rng(5)
    for size, spread in ((64, 5), (64, 1 << 20), (3, 1 << 24), (700, 1000)):
        known = rng.integers(-spread, spread + 1, (9, size))
        known[4] = known[1]  # a tie of centroids
        vectors = np.concatenate([rng.integers(-spread, spread + 1, (300, size)), known, (known[:4] + known[4:8]) // 2])
        found, distance, again = centroids.assign(vectors, known)
        whole = ((vectors[:, None, :].astype(object) - known[None].astype(object)) ** 2).sum(axis=2)
        assert found.tolist() == [row.index(min(row)) for row in whole.tolist()]
        assert distance.tolist() == [min(row) for row in whole.tolist()] and again > 0


def test_screening_decides_most_vectors():
    rng = np.random.default_rng(6)
    _, _, again = centroids.assign(rng.integers(-600, 600, (2000, 64)), rng.integers(-600, 600, (8, 64)))
    assert again < 40  # pairs, of 16,000


@pytest.mark.parametrize("k,rounds", [(1, 1), (4, 3), (8, 10), (500, 2)])
def test_clusters_like_brute_force(spark, k, rounds):
    random.seed(k)
    vectors = [[random.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(6)] for _ in range(120)]
    bad = [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [1.0] * 5 + [math.nan], [1.0] * 5 + [math.inf]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors + bad)], "vec_id int, embedding array<float>").repartition(5)
    order = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    kept = [[math.floor(1024 * float(np.float32(x))) for x in v] for v in vectors]
    first = [kept[i] for i in sorted(range(len(kept)), key=order)[:k]]
    assert centroids.seeds(rows, k, 6, 1024, q12_clusters.order(F.col("vec_id"))) == first
    now, of, distances = exact_clusters(kept, first, rounds)
    found = centroids.fit(rows, first, rounds)
    assert found.centroids == now and found.inertia == sum(distances) and found.counts == [of.count(j) for j in range(len(now))]
    out = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.assigned(rows, found, size=6).collect()}
    assert out == {i: x for i, x in enumerate(zip(of, distances))}


def test_clusters_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 2), (3, [1.0, 2.0], 3), (4, [-1.0, 0.5], 4)], "cluster int, embedding array<double>, distance int")
    first = centroids.seeds(rows, 8, 2, 10, F.coalesce("cluster", F.lit(0)).cast("long"))
    assert first == [[10, 20], [10, 20], [10, 20], [-10, 5]]  # equal centroids: the smallest number is taken
    found = centroids.fit(rows, first, 3, scale=10)
    assert found.counts == [3, 0, 0, 1]
    out = centroids.assigned(rows, found, size=2, scale=10, id_col="cluster", carry=True)
    assert out.columns == ["cluster_", "cluster", "distance", "row"]
    assert sorted((r["row"]["distance"], r["cluster"], r["distance"]) for r in out.collect()) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, 0)]
    none = rows.limit(0)
    nothing = centroids.fit(none, centroids.seeds(none, 8, 2, 10, F.lit(1)), 3)
    assert nothing.centroids == [] and nothing.inertia == 0 and centroids.assigned(none, nothing, size=2, id_col="cluster").count() == 0
    with pytest.raises(Exception, match="smaller scale"):
        centroids.assigned(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id int, embedding array<double>"), found, size=2).collect()


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def ranked(documents, items, k):
    words = [TERM.findall((t or "").translate(LOW)) for _, t in documents]
    tf = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in tf for t in c)
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    out = []
    for item, text in items:
        scores = []
        for (i, _), w, c in zip(documents, words, tf):
            score = 0
            for t in TERM.findall((text or "").translate(LOW)):
                if t in c:
                    m = 25 + (75 * len(w) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if unknown else i, -s) for rank, (s, unknown, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes,shard_docs,block", [(1 << 20, 1 << 16, 1 << 20), (300, 7, 40), (1, 1, 1 << 20)])
def test_search_like_brute_force_in_any_shards(spark, tmp_path, shard_bytes, shard_docs, block):
    random.seed(9)
    vocabulary = ["a", "B", "ñé", "É", "x1", "42", "the", "The", "日本"] + [f"w{k}" for k in range(40)]
    texts = [random.choice([" ", ", ", "_", "\n"]).join(random.choices(vocabulary, k=random.randint(0, 15))) for _ in range(90)]
    documents = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "the w3"), (200, texts[1]), (200, texts[1]), (201, None), (202, ""), (203, " .,"), (204, "w5 " * 5000)]
    items = [(1, "the w3 W3 ñé?"), (2, texts[1]), (3, None), (4, "zzz"), (5, ""), (None, "42 x1"), (1, "日本")]
    rows = spark.createDataFrame(documents, "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    index = lexical.build(rows, str(tmp_path / "index"), shard_bytes=shard_bytes, shard_docs=shard_docs)
    got = sorted([tuple(r) for r in lexical.search(index, asked, 10, block_bytes=block).collect()], key=str)
    assert got == ranked(documents, items, 10)


def test_ties_are_not_cut_by_chance():
    scores = np.array([5, 7, 7, 7, 0, 7, 9])
    ids, unknown = np.array([1, 9, 3, 4, 5, 0, 2]), np.array([0, 0, 0, 0, 0, 1, 0], bool)
    assert lexical.best(scores, ids, unknown, 3).tolist() == [6, 2, 3]
    assert lexical.best(scores, ids, unknown, 9).tolist() == [6, 2, 3, 1, 5, 0]
    assert lexical.best(np.zeros(4, np.int64), ids[:4], unknown[:4], 2).tolist() == []


def test_impacts_beyond_64_bits_in_between():
    tf, n = np.array([1, 3, 10**9]), np.array([5, 10**12, 10**12])
    big = lexical.impact(tf, n, 10**11, 10**14)
    assert big.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 10**11 // 10**14)) for t, m in zip(tf.tolist(), n.tolist())]


def test_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id int, text string")
    index = lexical.build(none, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "a")], "rank int, text string")
    assert lexical.search(index, asked, item_col="rank").columns == ["rank_", "rank", "doc_id", "score"]
    assert lexical.search(index, asked, item_col="rank").count() == 0
    some = lexical.build(spark.createDataFrame([(1, "a")], "doc_id int, text string"), str(tmp_path / "some"))
    assert lexical.search(some, asked.limit(0), item_col="rank").count() == 0
