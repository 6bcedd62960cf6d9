"""Hand cases of the assessment, the chunk store, answers and the rules that were mended."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.functions import text
from stancelake.operators import assessment, boards, evaluation, features, ingest, resampling, retrieval, series, speeches


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}")
    return [r[1] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_default_lexicon(spark):
    said = ["A rate hike and a hike.", "Not accommodative.", "There is no further tightening.", "We withdraw accommodation.", "plain", None, "", "Rate hikes! rate cuts", "don't be patient", "reaccommodation easing"]
    got = column(spark, said, text.lexicon())
    assert [(r["hawkish_hits"], r["dovish_hits"]) for r in got] == [(2, 0), (1, 0), (0, 1), (1, 0), (0, 0), (0, 0), (0, 0), (1, 1), (1, 0), (0, 1)]
    assert [r["score"] for r in got] == [1, 1, -1, 1, 0, 0, 0, 0, 1, -1]


def test_spans_that_overlap():
    assert text._apart([(5, 9, 1), (0, 6, -1), (9, 12, 1), (8, 10, 1), (0, 5, 1)]) == [(0, 5, 1), (5, 9, 1), (9, 12, 1)]


def test_default_gate(spark):
    assert column(spark, ["The policy rate is high.", "Thank you all.", "pirate", None], text.is_relevant)[:3] == [True, False, False]


def test_disagreement_needs_a_lexicon_that_fired(spark):
    rows = spark.createDataFrame([(0.0, 0.8, True), (0.9, 0.0, False), (0.9, 0.0, True), (0.2, -0.1, True), (0.3, 0.6, True)], "a double, b double, fired boolean")
    assert [r[0] for r in rows.select(boards.disagrees(F.col("a"), F.col("b"), F.col("fired"))).collect()] == [True, False, True, True, False]


def test_hash_embedding_is_brute_force(spark):
    grams = ["rate", "hike", "rate hike", "rate"]
    want = np.zeros(32)
    for g in grams:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        want[h % 32] += 1 if (h // 2**33) % 2 else -1
    want /= math.sqrt((want**2).sum())
    got = column(spark, [grams, [], None], lambda x: retrieval.hash_embedding(x, 32), "array<string>")
    assert got[0] == pytest.approx(want) and got[1] == got[2] == [0.0] * 32


def test_verdicts_beside_sentences(spark):
    rows = [(["a", "b", "c", "d", "e"], 5), (["a", "b", "c", "d", "e"], 4), (["a", "b", "c", "d", "e"], 3), (["a"], 0), ([], 0), (["a"], None), (["a", "b", "c", "d"], 5)]
    frame = spark.createDataFrame([(k, s, [("hawkish", 1.0)] * n if n is not None else None) for k, (s, n) in enumerate(rows)], f"k int, s array<string>, v {assessment.VERDICTS}")
    got = [r["x"] for r in frame.select("k", assessment.aligned(F.col("s"), F.col("v")).alias("x")).orderBy("k").collect()]
    assert [None if x is None else len(x) for x in got] == [5, 4, None, None, 0, None, 4] and got[0][0]["label"] == "hawkish"


def test_assessment_and_its_degraded_form(spark):
    said = "Inflation will rise and a rate hike is likely. Easing was over. Thanks to all. The outlook for growth is fine."
    rows = spark.createDataFrame([(1, said, 0.5, "federal_reserve"), (2, said, 0.5, "other"), (3, None, -0.4, "other"), (4, "No topic here.", 0.0, None)], "doc_id int, text string, headline double, bank string")
    got = {r["doc_id"]: r for r in assessment.assess(rows, assessment.by_terms(), assessment.by_terms(("easing",), ("hike", "outlook"))).collect()}
    one = got[1]
    assert (one["sentences"], one["relevant"], one["hawkish"], one["dovish"], one["tone"]) == (4, 3, 1, 1, "mixed") and one["net"] == 0 and one["forward_net"] == 0.5
    assert one["classifier_net"] == pytest.approx(-1 / 3) and one["fired"] and one["lexicon_score"] == 0 and not one["degraded"]
    assert one["aspects"] == {"inflation": 1.0, "guidance": 0.0, "other": -1.0} or one["aspects"] == {"inflation": 1.0, "growth": 0.0, "other": -1.0}
    assert one["uncertainty"] == pytest.approx(1 / 3) and got[2]["uncertainty"] == 0 and not got[2]["needs_review"]
    assert (got[3]["sentences"], got[3]["relevant"], got[3]["tone"], got[3]["aspects"], got[4]["relevant"]) == (0, 0, "neutral", {}, 0)
    failing = lambda s: F.lit(None).cast(assessment.VERDICTS)
    bad = {r["doc_id"]: r for r in assessment.assess(rows, failing, assessment.by_terms()).collect()}
    assert bad[1]["degraded"] and bad[1]["headline"] == 0.5 and (bad[1]["relevant"], bad[1]["net"], bad[1]["tone"]) == (0, 0, "neutral") and bad[1]["fired"]
    assert assessment.assess(rows.limit(0), assessment.by_terms(), assessment.by_terms()).count() == 0


def test_offline_tone_and_summary(spark):
    said = ["A hike. A hike. Easing. Words.", "Words only here", "", None, "Lead. Easing and stimulus. Nothing. A hike with easing. Tightening.", "  "]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    tone = {r["doc_id"]: r for r in assessment.offline_tone(rows, assessment.by_terms()).collect()}
    assert tone[0]["score"] == pytest.approx(1 / 3) and tone[0]["tone"] == "hawkish" and tone[0]["rationale"].endswith("2/4 hawkish, 1/4 dovish, 1/4 neutral sentences; net hawkishness +0.33.")
    assert (tone[1]["tone"], tone[1]["sentences"], tone[2]["sentences"], tone[3]["tone"]) == ("neutral", 1, 1, "neutral")
    got = {r["doc_id"]: r["summary"] for r in assessment.offline_summary(rows, assessment.by_terms()).collect()}
    assert got == {0: "A hike. A hike. Easing.", 1: "Words only here", 2: "(no text)", 3: "(no text)", 4: "Lead. Easing and stimulus. Tightening.", 5: "(no text)"}


def test_softmax_scorer_is_that_of_the_weights(spark):
    scorer = assessment.by_softmax(["hike", "rate hike"], np.array([1.0, 2.0]), np.array([[1.0, 0, 0], [2.0, 0, 0]]), np.array([0.1, 0.3, 0.0]))
    got = column(spark, [["Rate hike now", "nothing"], [], None], scorer, "array<string>")
    assert [v["label"] for v in got[0]] == ["hawkish", "dovish"] and got[1] == [] and got[2] is None
    z = np.array([(1 * 1 + 2 * 2) / math.sqrt(5) + 0.1, 0.3, 0.0])
    p = np.exp(z) / np.exp(z).sum()
    assert got[0][0]["score"] == pytest.approx(p[0] - p[1])


SPEECHES = [(1, "a", "Rates rose because of inflation in May. Food was good.", "One", "u1"), (2, "a", "The balance sheet will shrink over the next years.", "Two", "u2"), (3, "b", "Our dogs like the garden very much today.", "Three", "u3"), (4, "b", None, "Four", "u4")]


@pytest.fixture()
def library(spark):
    rows = spark.createDataFrame(SPEECHES, "speech_id int, speaker_id string, text string, title string, url string")
    return rows, speeches.hash_embedder(64)


def test_index_once_and_reload(spark, library, tmp_path):
    rows, embed = library
    path = str(tmp_path / "store")
    assert speeches.open_store(spark, path) is None
    assert speeches.index_speech(rows, 1, path, embed) == 1 and speeches.index_speech(rows, 1, path, embed) == 0
    assert speeches.index_speeches(rows, path, embed) == 2 and speeches.index_speeches(rows, path, embed) == 0
    store = speeches.open_store(spark, path)
    assert {r["speech_id"]: r["chunks"] for r in speeches.chunk_counts(store).collect()} == {1: 1, 2: 1, 3: 1}
    assert store.schema["embedding"].dataType.simpleString() == "array<float>" and ", ".join(store.columns) == speeches.STORE
    with pytest.raises(errors.EntityNotFound):
        speeches.index_speech(rows, 99, path, embed)
    short = lambda texts: F.slice(embed(texts), 1, 0)
    with pytest.raises(Exception, match="ScorerFailed: 0 vectors for 1 chunks"):
        speeches.index_speeches(rows, str(tmp_path / "other"), short)


def test_answers(spark, library, tmp_path):
    rows, embed = library
    speeches.index_speeches(rows, str(tmp_path / "s"), embed)
    store, speakers = spark.read.parquet(str(tmp_path / "s")), rows.select("speaker_id")
    got = speeches.ask_speaker(store, rows, speakers, "a", "why have rates and inflation risen in May", embed, most_distance=0.95).first()
    assert not got["abstained"] and got["answer"].startswith(speeches.PREFIX + "\n\n- Rates rose because of inflation in May. (One)") and tuple(got["citations"][0]) == (1, 0, "One", "u1")
    off = speeches.ask_speaker(store, rows, speakers, "b", "quantitative", embed).first()
    assert (off["answer"], off["citations"], off["abstained"]) == (speeches.NOTHING_OF_SPEAKER, [], True)
    assert speeches.ask_corpus(store, rows, "zzz", embed).first()["answer"] == speeches.NOTHING_OF_ANY
    whole = speeches.ask_corpus(store, rows, "the dogs like the garden", embed, k=1, most_distance=1.0).first()
    assert whole["citations"][0]["title"] == "Three" and len(whole["citations"]) == 1
    with pytest.raises(errors.EntityNotFound):
        speeches.ask_speaker(store, rows, speakers, "nobody", "x", embed)
    few = spark.createDataFrame([(1, 0, " Too short. ", "T", "u", 0.1)], "speech_id int, chunk_index int, text string, title string, url string, distance double")
    assert speeches.answer_of(few, "q", embed, "n").first()["answer"] == speeches.PREFIX + "\n\n- Too short. (T)"
    joined = speeches.chunks_of_speeches(store, rows, "title", only=F.col("speaker_id") == "a")
    assert {r["title"] for r in joined.collect()} == {"One", "Two"}


def test_approximate_search_has_recall(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(20, 16))
    vectors = [(i, [float(x) for x in middle[i % 20] + 0.4 * rng.normal(size=16)]) for i in range(3000)]
    rows = spark.createDataFrame(vectors, "vec_id int, embedding array<double>")
    queries = rows.where("vec_id % 100 = 0")
    exact = retrieval.nearest_each(rows, queries, 5).select(F.col("query").cast("int").alias("query"), F.col("id").cast("int").alias("id"))
    centres = speeches.centroids(rows, 32, most=1000)
    found = speeches.nearest_by_lists(rows, queries, centres, 5, probes=6)
    assert speeches.recall(found, exact) >= 0.9 and found.groupBy("query").count().where("count <> 5").count() == 0
    every = speeches.nearest_by_lists(rows, queries, centres, 5, probes=32)
    assert speeches.recall(every, exact) == 1.0


def test_bootstraps_keep_to_their_rules(spark):
    pairs = spark.createDataFrame([("n", "s", 0, 1, 1.0, 2.0), ("n", "s", 0, 2, 2.0, 1.0)], "name string, series string, horizon int, month int, x double, y double")
    assert tuple(series.block_bootstrap(pairs, 100).first())[3:6] == (0.0, 0.0, 0.0)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=11), rng.normal(size=11)
    rows = spark.createDataFrame([("n", "s", 3, m, float(x[m]), float(y[m])) for m in range(11)], pairs.schema)
    found = series.block_bootstrap(rows, 200, family=1).first()
    drawn = resampling.intervals(rows, ["name"], ["month"], block=series.block_length(11, 3), draws=200).first()
    assert found["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and (found["low"], found["high"]) == (drawn["low"], drawn["high"])
    years = [("c", 2000 + i, float(v), float(w)) for i, (v, w) in enumerate([(3, 1), (1, 2), (2, 5), (5, 4)])]
    frame = spark.createDataFrame(years, "cell string, year int, x double, y double")
    a, b = (series.paired_bootstrap(f, "cell", draws=200, statistic="slope").first() for f in (frame, frame.orderBy(F.desc("x")).repartition(3)))
    assert a[0] == b[0] and list(a[1:]) == pytest.approx(list(b[1:]))
    assert a["low"] <= a["value"] <= a["high"] and a["value"] == pytest.approx(np.polyfit([3, 1, 2, 5], [1, 2, 5, 4], 1)[0])


def test_mcnemar_is_not_bounded(spark):
    rows = spark.createDataFrame([("a", "a", "b"), ("a", "b", "a"), ("a", "a", "a")], "gold string, first string, second string")
    got = evaluation.with_p(evaluation.mcnemar(rows)).first()
    assert got["chi2"] == 0.5 and got["p"] == pytest.approx(math.erfc(0.5))
    assert evaluation.with_p(evaluation.mcnemar(rows.where("first = second"))).first()["p"] == 1.0
    shares = spark.createDataFrame([("a", 0.8, 0.2), ("b", 0.6, 0.4)], "gold string, x double, y double")
    assert evaluation.brier(shares, {"a": "x", "b": "y"}).first()[0] == pytest.approx((0.08 + 0.72) / 2)


def test_first_of_text_with_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (2, "b"), (5, None), (6, "")], "doc_id int, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in ingest.first_of_text(rows).collect())
    assert [x[0] for x in got] == ["2", "5", "None"]
    path = str(tmp_path / "t")
    assert ingest.ingest(rows, path) == 3 and ingest.ingest(rows, path) == 0 and spark.read.parquet(path).count() == 3


def test_samples_by_position(spark):
    rows = spark.range(500).withColumn("id", 1000 - F.col("id"))
    want = sorted(random.Random(4).sample(range(500), 20))
    got = sorted(r["id"] for r in evaluation.sampled(rows, 20, "id", 4).collect())
    assert got == [501 + p for p in want] and evaluation.sampled(rows.limit(3), 20, "id").count() == 3


def test_orders_codes_and_errors(spark):
    rows = spark.createDataFrame([(2, "b", 5), (1, "b", 5), (3, "a", 7)], "id int, name string, ts int")
    assert [r["id"] for r in boards.by_name(rows).collect()] == [3, 1, 2] and [r["id"] for r in boards.in_time(rows).collect()] == [1, 2, 3] and [r["id"] for r in boards.in_time(rows, True).collect()] == [3, 1, 2]
    shown = spark.createDataFrame([("federal_reserve", 0.25), ("x", -2.0)], "bank string, score double")
    bar = boards.stance_bar(F.col("score"))
    got = [tuple(r) for r in shown.select(boards.desk_label(F.col("bank")), boards.desk_code(F.col("bank"), {"federal_reserve": "FED"}), *bar.values()).collect()]
    assert got == [("Federal Reserve", "FED", "hawk", 12.5, 25), ("X", None, "dove", 50.0, -200)]
    with pytest.raises(errors.InvalidInput):
        boards.known_bank("nowhere", ("here",))
    with pytest.raises(errors.InsufficientData):
        series.with_history(spark.createDataFrame([(m, 1.0) for m in range(11)], "month int, x double"))
    index, rates = (spark.createDataFrame([(m,) for m in ms], "month int") for ms in ((3, 5, 9), (1, 4, 5, 8, 12)))
    assert tuple(series.span_union(rates, index).first()) == (3, 9, 5)


def test_ranks_by_bands_are_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, rng.choice([None, round(rng.uniform(-1, 1), 2)])) for k in range(300)]
    got = {(r["bank"], r["member"]): r["rank"] for r in boards.ranked_members(spark.createDataFrame(rows, "bank string, member int, score double")).collect()}
    for bank in "ab":
        order = sorted((r for r in rows if r[0] == bank), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[bank, r[1]] for r in order] == list(range(1, len(order) + 1))


def test_training_and_choice_of_penalty(spark):
    rng = random.Random(2)
    words = {"hawkish": "hike tighten", "dovish": "cut ease", "neutral": "meet talk"}
    rows = [(i, " ".join([rng.choice(words[c].split()), rng.choice("a b c".split()), rng.choice(words[c].split())]), c) for i in range(90) for c in [list(words)[i % 3]]]
    frame = spark.createDataFrame(rows, "doc_id int, text string, label string")
    weights = features.tfidf(frame, least=2)
    w, b = features.train_softmax(frame, weights, epochs=60)
    joined = weights.join(features.model_table(spark, w), "column")
    said = features.softmax_scores(frame, joined, {c: F.col(c) for c in features.CLASSES}, dict(zip(features.CLASSES, map(float, b))))
    assert said.join(frame.withColumnRenamed("label", "gold"), "doc_id").where("label = gold").count() >= 88
    known = features.labelled_rows(frame, weights)
    x, gold = np.zeros((90, len(w))), (known["label"].to_numpy()[:, None] == np.array(features.CLASSES)).astype(float)
    for i, (c, v) in enumerate(zip(known["columns"], known["weights"])):
        x[i, np.asarray(c, int)] = v
    theta, bias = features.fit_softmax(known, 0.01, 1, 0.5, features.CLASSES)
    slope = x.T @ ((np.full((90, 3), 1 / 3) - gold) / 90)
    assert np.sign(theta[np.abs(slope) > 1e-9]).tolist() == np.sign(-slope[np.abs(slope) > 1e-9]).tolist() and np.abs(bias).max() < 0.51
    best, means = features.choose_penalty(frame, frame, (1e-3, 10.0), epochs=30, least=1)
    assert best == 1e-3 and means[1e-3] > 0.9
    assert len(features.labelled_rows(frame, weights, most=7)) == 7


def test_services_are_called_again():
    waits, left = [], [429, 503]

    class Busy(Exception):
        pass

    def call():
        if left:
            raise Busy(left.pop())
        return "ok"

    from stancelake.functions import calls

    assert calls.again(call, lambda e: e.args[0], wait=waits.append) == "ok" and waits == [2.0, 4.0]
    left.extend([500] * 9)
    with pytest.raises(errors.ScorerFailed):
        calls.again(call, lambda e: e.args[0], wait=waits.append)
    left[:] = [404]
    with pytest.raises(Busy):
        calls.again(call, lambda e: e.args[0], wait=waits.append)
    assert calls.in_batches(list(range(250)), lambda x: [v + 1 for v in x]) == list(range(1, 251))
    with pytest.raises(errors.ScorerFailed):
        calls.in_batches([1, 2], lambda x: x[:1])


def test_batches_are_seen_whole(spark, tmp_path):
    root = str(tmp_path / "lake")
    frame = lambda n: spark.createDataFrame([(n,)], "k int")
    ingest.publish({"speech": frame(1), "stance": frame(2)}, root, "a")
    frame(9).write.parquet(f"{root}/speech/batch=b")  # a write that failed half-way
    assert [r["k"] for r in ingest.published(spark, root, "speech").collect()] == [1]
    ingest.publish({"speech": frame(3), "stance": frame(4)}, root, "b")
    assert sorted(r["k"] for r in ingest.published(spark, root, "speech").collect()) == [1, 3] and ingest.published(spark, root, "stance").count() == 2


def test_labelled_csv_and_missing_files(spark, tmp_path):
    from stancelake.sources import archive, rates

    (tmp_path / "l.csv").write_text('id,sentence,4_stance_nli\n1,"We, must hike",Entailment\n2,Words,neutral\n3,Other,unknown\n4,,contradiction\n5,Cut it, contradiction\n')
    assert sorted(map(tuple, archive.read_labelled_csv(spark, str(tmp_path / "l.csv")).collect())) == [("Cut it", "dovish"), ("We, must hike", "hawkish"), ("Words", "neutral")]
    for read in (lambda p: archive.read_labelled_csv(spark, p), lambda p: rates.read_daily(spark, p, "x")):
        with pytest.raises(errors.BenchmarkUnavailable):
            read(str(tmp_path / "none.csv"))


def test_a_failing_item_never_stops_the_stream(spark, tmp_path):
    from stancelake.streaming import standing

    spark.createDataFrame([(1, "good text"), (2, "x"), (3, None)], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    query = standing.stream_ingest(rows, str(tmp_path / "t"), str(tmp_path / "c"), rules={"length": F.char_length("text") > 3}, rejects=str(tmp_path / "r"))
    query.awaitTermination()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]
    assert sorted((r["doc_id"], r["reasons"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(2, ["length"]), (3, ["length"])]
