"""One automaton over all lists gives the hits of each list by itself."""

import random

import pytest
from pyspark.sql import functions as F

from stancelake.functions import matching, text
from stancelake.operators import assessment

LISTS = {"a": ["rate", "rate hike", "hike", "hike", "don't"], "b": ["hike", "at", "ehi", "e hi", "x-y", ""], "none": [], "c": ["not", "n't not"]}


def texts():
    rng = random.Random(4)
    pieces = ["rate", "rates", "hike", "Hike", "a rate hike", "rate  hike", "don't", "don't not", "'hike'", "hiké", "at", "x-y", ".", " ", "\n", "é", "not", "pirate hikes"]
    return [None, "", "hike", *[rng.choice(["", " "]).join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(300)]]


def test_hits_are_those_of_each_list(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "k int, t string")
    each = {name: text.term_hits(F.coalesce("t", F.lit("")), [t for t in terms if t]) if terms else F.lit(0) for name, terms in LISTS.items()}
    got = rows.select("k", matching.hits(F.array("t"), LISTS)[0].alias("hits"), F.array(*each.values()).alias("want")).collect()
    assert all(r["hits"] == r["want"] for r in got) and any(sum(r["hits"]) > 3 for r in got)
    assert rows.select(matching.hits(F.lit(None).cast("array<string>"), LISTS).alias("h")).first()["h"] is None
    assert rows.limit(0).select(matching.hits(F.array("t"), LISTS)).count() == 0


def test_cues_give_aspect_and_horizon(spark):
    rng = random.Random(2)
    cues = sorted({t for _, terms in text.ASPECT_CUES for t in terms} | set(text.FORWARD_CUES) | set(text.BACKWARD_CUES))
    rows = spark.createDataFrame([(k, " ".join(rng.choices(cues, k=rng.randint(0, 4)))) for k in range(200)], "k int, t string")
    hits = matching.hits(F.array("t"), assessment.CUES)[0]
    got = rows.select(hits.alias("hits"), text.aspect(F.col("t")).alias("aspect"), text.horizon(F.col("t")).alias("horizon"))
    got = got.select("aspect", "horizon", assessment._aspect_of(F.col("hits")).alias("a"), assessment._horizon_of(F.col("hits")).alias("h")).collect()
    assert all((r["a"], r["h"]) == (r["aspect"], r["horizon"]) for r in got) and len({r["a"] for r in got}) > 3


@pytest.mark.parametrize("lists", [{}, {"only": []}])
def test_no_terms(lists):
    assert matching.Terms(lists).counts("any text").tolist() == [0] * len(lists)
