"""What is made of texts in Python is made a step at a time, and comes to the same."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stancelake.functions import text
from stancelake.operators import assessment, features, retrieval, speeches


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    words = ["rate", "hike", "easing", "was", "the", "of", "outlook", "zz"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice([".", "!", ""]) for _ in range(200)]
    return spark.createDataFrame([*enumerate([*said, "", None, "one two three four. one two three four. rate"])], "doc_id int, text string").repartition(3)


def test_steps_are_bounded_and_whole():
    column = pa.array(["abc", None, "", "x" * 50, "de", "f"])
    assert list(text.steps(column, 5)) == [(0, 3), (3, 4), (4, 6)] and list(text.steps(pa.array([], pa.string()))) == []
    lists = pa.array([["ab", "c"], None, [], ["x" * 9, None], ["d"]]).slice(1)
    assert list(text.steps(lists, 4)) == [(0, 2), (2, 3), (3, 4)]
    assert text.by_steps(column, lambda mine: [len(x or "") for x in mine], pa.int64(), 5).to_pylist() == [3, 0, 0, 50, 2, 1]


def test_small_steps_change_nothing(spark, rows, monkeypatch):
    embed, verdicts = speeches.hash_embedder(16), assessment.by_terms()
    made = lambda: [rows.select("doc_id", text.chunk(F.col("text"), 20, 5), retrieval.text_embedding(F.col("text"), 16), embed(F.when(F.col("text") != "", F.array("text", F.lit(None)))), verdicts(F.array("text"))), features.tfidf(rows, least=1)]
    want = [sorted(map(str, x.collect())) for x in made()]
    monkeypatch.setattr(text.steps, "__defaults__", (7,))
    monkeypatch.setattr(text.by_steps, "__defaults__", (7,))
    assert [sorted(map(str, x.collect())) for x in made()] == want
    one = retrieval.hash_embedding(text.ngrams(text.tokens(F.coalesce(F.col("text"), F.lit(""))), 2), 16)
    assert rows.select((one == retrieval.text_embedding(F.col("text"), 16)).alias("same")).where("NOT same").isEmpty()


def test_hashes_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(retrieval, "KEPT", 50)
    one = retrieval.gram_hasher(8)
    places = one.many.__closure__[[*one.many.__code__.co_freevars].index("places")].cell_contents
    for k in range(100):
        one([f"{k} {j}" for j in range(10)])
        assert len(places) <= 50


def test_grams_counted_in_tasks(rows, monkeypatch):
    want = sorted(map(tuple, features.document_frequency(features.grams(rows), 2).collect()))
    assert sorted(map(tuple, features.gram_counts(rows, 2).collect())) == want
    monkeypatch.setattr(features, "COUNTED", 3)
    assert sorted(map(tuple, features.gram_counts(rows, 2).collect())) == want


def test_answer_is_of_the_best_sentences_of_all_tasks(spark, rows):
    question, one = "the rate was of the outlook", retrieval.gram_hasher(32)
    places = {}
    for r in rows.collect():
        for at, s in enumerate(x.strip() for x in (r["text"] or "").replace("!", "!\0").replace(".", ".\0").split("\0") if x.strip()):
            if len(s.split()) >= 4:
                places[s] = min(places.get(s, (r["doc_id"], at)), (r["doc_id"], at))
    like = {s: round(float(one(text.grams_of(s)) @ one(text.grams_of(question))), 9) for s in places}
    want = sorted(places, key=lambda s: (-like[s], places[s]))[:4]
    got = retrieval.extractive_answer(rows, question, k=4, dim=32, id_col="doc_id").first()
    assert got["answer"] == " ".join(want) and got["sentences"] == 4


def test_a_second_run_shuffles_no_texts(spark, rows, tmp_path):
    embed, path = speeches.hash_embedder(8), str(tmp_path / "store")
    named = rows.withColumnRenamed("doc_id", "speech_id")
    first = speeches.index_speeches(named.where("speech_id < 100"), path, embed)
    assert first > 0 and speeches.index_speeches(named.where("speech_id < 100"), path, embed) == 0
    assert speeches.index_speeches(named.unionByName(named), path, embed) > 0
    assert speeches.index_speeches(named, path, embed) == 0
    ids = {r["speech_id"] for r in spark.read.parquet(path).collect()}
    assert ids == {r["doc_id"] for r in rows.collect() if (r["text"] or "").split()}
