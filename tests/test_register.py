"""The register of observations, the offline model as one object, and what the package exports."""

import datetime

import pytest
from pyspark.sql import functions as F

import stancelake
from stancelake import errors
from stancelake.functions import text
from stancelake.operators import assessment, observations, offline, speeches

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "id int, speaker_id string, tone string, score double, source_text string, observed_at timestamp"


def test_register_records_and_lists(spark, tmp_path):
    speakers = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    book = observations.Register(spark, str(tmp_path), speakers)
    rows = spark.createDataFrame([(1, "a", "hawkish", 0.5, "x", DAY), (2, "a", "dovish", -0.5, "y", DAY - datetime.timedelta(1)), (3, "z", "mixed", 0.0, "", DAY), (4, "a", "mixed", 2.0, None, DAY), (5, None, "mixed", 0.0, "t", DAY)], SCHEMA)
    bad = {r["id"]: sorted(r["reasons"]) for r in book.record(rows, "one").collect()}
    assert bad == {3: ["speaker_id"], 4: ["score", "source_sha256"], 5: ["speaker_id"]}
    book.record(spark.createDataFrame([(6, "a", "neutral", 0.0, "z", None)], SCHEMA), "two", now=F.lit(DAY), needs_review=F.lit(True))
    got = book.of_speaker("a").collect()
    assert [r["id"] for r in got] == [2, 1, 6] and got[2]["observed_at"] == DAY and got[2]["needs_review"] and "source_text" not in got[0].asDict()
    assert book.of_speaker("a", 1).count() == 2 and book.of_speaker("b").count() == 0
    assert {r["id"]: r["place"] for r in book.numbered().collect()} == {2: 1, 1: 2, 6: 3}
    with pytest.raises(errors.ImmutableRecord):
        book.record(rows, "one")
    with pytest.raises(errors.EntityNotFound):
        book.of_speaker("z")


def test_only_scored_speeches_are_joined(spark):
    speeches_ = spark.createDataFrame([(1, "t"), (2, "u"), (None, "v")], "speech_id int, title string")
    stances = spark.createDataFrame([(1, 0.5), (9, 0.1), (None, 0.2)], "speech_id int, net double")
    assert [tuple(r) for r in observations.scored(speeches_, stances, "speech_id", "net").collect()] == [(1, "t", 0.5)]


def test_offline_model_is_the_functions_behind_one_interface(spark):
    model = offline.Offline(dim=32, digest="md5")
    rows = spark.createDataFrame([(1, "Tightening is needed. It rains."), (2, None), (3, "Easing and stimulus.")], "doc_id int, text string")
    for name, mine, theirs in (("tones", model.tones(rows), assessment.offline_tone(rows, assessment.by_terms())), ("summaries", model.summaries(rows), assessment.offline_summary(rows, assessment.by_terms()))):
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect())), name
    vectors = rows.select(model.embed(F.array("text")).alias("a"), speeches.hash_embedder(32, "md5")(F.array("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in vectors) and len(vectors[0]["a"][0]) == 32
    found = spark.createDataFrame([], "speech_id int, chunk_index int, text string, title string, url string, distance double")
    assert model.answer(found, "why", "nothing").first()["abstained"]
    own = offline.Offline(scorer=assessment.by_terms(("rain",), ()))
    assert own.tones(rows).where("tone = 'hawkish'").count() == 0 and own.name == "offline"


def test_the_package_exports_its_operators():
    for name in stancelake.__all__:
        assert getattr(stancelake, name) is not None
    assert stancelake.sentences is text.sentences
    with pytest.raises(AttributeError):
        stancelake.nothing_of_the_kind
