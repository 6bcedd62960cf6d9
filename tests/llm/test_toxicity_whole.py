"""Toxicity learnt from all labelled texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm import q06_toxicity, toxicity


def _texts(spark, n):
    rude = F.concat(F.lit("you vile fool number "), F.col("id"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, rude).otherwise(F.concat(F.lit("a calm note about item "), F.col("id"))).alias("text"))


def _labels(documents):
    return documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("label"))


def test_op6_learns_every_labelled_text(spark, tmp_path, monkeypatch):
    documents = _texts(spark, 9_000)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen, odds_of, calibrate = {}, toxicity.odds_of, toxicity.calibrate
    monkeypatch.setattr(toxicity, "odds_of", lambda have, ones, zeros: (seen.update(have=have, learnt=ones + zeros), odds_of(have, ones, zeros))[1])
    monkeypatch.setattr(toxicity, "calibrate", lambda z, langs, ones, zeros: (seen.update(back=int(ones.sum() + zeros.sum())), calibrate(z, langs, ones, zeros))[1])
    q06_toxicity.model(spark, str(tmp_path))
    due = documents.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0").count()
    assert due > 2 * toxicity.MOST_EACH and seen["learnt"] + seen["back"] == due
    # words that all texts of a label have are counted in each of them
    assert seen["have"].sum(axis=0).max() >= seen["learnt"] / 2 - 200


def test_parts_not_partitions_decide(spark):
    documents = _texts(spark, 600)
    one = toxicity.train_whole(documents.repartition(1), _labels(documents), part_bytes=4_000, rounds=2, least_steps=20)
    many = toxicity.train_whole(documents.repartition(7), _labels(documents).repartition(3), part_bytes=4_000, rounds=2, least_steps=20)
    assert (one.look_ups == many.look_ups).all() and (one.thresholds == many.thresholds).all()
    got = toxicity.score(documents, one).selectExpr("avg(int((score >= 0.5) = (doc_id % 2 = 1)))").first()[0]
    assert got > 0.99


def test_weights_are_averaged_over_the_parts_that_moved_them():
    params = toxicity.start(np.zeros(toxicity.TABLE), np.random.default_rng(1))
    rows = np.zeros((toxicity.TABLE, 1 + toxicity.DIM))
    rows[3], rows[4] = 2, [1] + [5] * toxicity.DIM
    rest = [np.full(v.size, 12.0) for k, v in params.items() if k != "emb"]
    out = toxicity._apply(params, np.concatenate([rows.ravel(), *rest, [4]]))
    moved = out["emb"] - params["emb"]
    assert np.allclose(moved[3], 1) and np.allclose(moved[4], 5) and not moved[5:].any()
    assert all(np.allclose(out[k] - params[k], 3) for k in params if k != "emb")


@pytest.mark.parametrize("most", [toxicity.MOST_BROADCAST, 1])
def test_odd_ids_and_labels(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", most)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (4, "d"), (None, "e"), (5, "f")], "id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (9, 1), (5, 0), (5, 0), (4, None)], "id long, label int")
    got = toxicity._labelled_texts(rows, toxicity.sampling.agreed(labels, "label", "id")).collect()
    assert sorted((r["id"], r["label"]) for r in got) == [(1, 1), (2, 0), (5, 0)]
    documents = rows.withColumnRenamed("id", "doc_id")
    for some in (labels, labels.where("label = 0"), labels.limit(0)):
        model = toxicity.train_whole(documents, some)
        assert toxicity.score(documents, model).where("score BETWEEN 0 AND 1").count() == 7
