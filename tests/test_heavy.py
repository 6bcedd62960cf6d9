"""Grams in most texts by summaries: the terms of the full count, whatever the number of counters, and what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from stancelake.operators import features, heavy


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(100)], k=rng.randint(0, 30)))) for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id int, text string").repartition(6)


def full(texts, least, wanted):
    return sorted(map(tuple, features.vocabulary(features.grams(texts), least, wanted).select("gram", "df", "column").collect()))


@pytest.mark.parametrize("counters", [1, 20, 300, 1 << 15])
@pytest.mark.parametrize("least,wanted", [(1, 10), (3, 60), (2, 5000)])
def test_terms_are_those_of_the_full_count(spark, texts, counters, least, wanted):
    got = heavy.vocabulary(texts, least, wanted, counters=counters)
    assert sorted(map(tuple, got.select("gram", "df", "column").collect())) == full(texts, least, wanted)


def test_ties_and_no_rows(spark, texts):
    rows = spark.createDataFrame([(k, "b a c") for k in range(9)] + [(9, "d")], "doc_id int, text string")
    assert [tuple(r) for r in heavy.document_frequency(rows, 4, 1, counters=2).orderBy(F.desc("df"), "gram").collect()] == [("a", 9), ("a c", 9), ("b", 9), ("b a", 9)]
    assert heavy.document_frequency(texts.limit(0)).count() == 0


def test_candidates_beyond_what_is_sent_are_joined(spark, texts):
    able = features.grams(texts).select("gram").distinct()
    few = heavy._counted(texts.select("text"), able, 2, 1)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in features.document_frequency(features.grams(texts), 1).collect()}


def test_summaries_are_short_by_what_was_taken():
    rng = random.Random(1)
    summary, true = heavy.Summary(8), {}
    for _ in range(500):
        grams = {str(int(rng.expovariate(0.2))) for _ in range(3)}
        for g in grams:
            true[g] = true.get(g, 0) + 1
        summary.add(grams)
    rows = dict(zip(*[c.to_pylist() for c in summary.rows().columns]))
    taken = rows.pop(None)
    assert len(rows) <= 8 and all(rows.get(g, 0) <= n <= rows.get(g, 0) + taken for g, n in true.items())
    assert taken <= sum(true.values()) / 8
