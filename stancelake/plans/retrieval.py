"""Queries over vectors and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import blocks, retrieval
from stancelake.plans.registry import register
from stancelake.session import table, texts

_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0), d AS (SELECT vec_id, label, 1 - list_cosine_similarity(e, qe) AS distance FROM v, q)"
_SHOWN = "round(distance, 9) + 0.0 AS distance"


def _query(vectors: DataFrame) -> list[float]:
    return vectors.where("vec_id = 0").first()["embedding"]


@register("nearest_chunks", f"WITH {_VECTORS} SELECT vec_id, {_SHOWN} FROM d ORDER BY round(d.distance, 12), vec_id LIMIT 10")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors, _query(vectors), 10).select("vec_id", (F.abs(F.round("distance", 9)) + 0.0).alias("distance"))


@register("nearest_chunks_for_speaker", f"WITH {_VECTORS} SELECT vec_id, label, {_SHOWN} FROM (SELECT * FROM d WHERE label = 3 ORDER BY round(d.distance, 12), vec_id LIMIT 5) t WHERE t.distance <= 0.95")
def nearest_chunks_for_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance cut comes after the top k, so there may be fewer."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest(vectors, _query(vectors), 5, 0.95, F.col("label") == 3)
    return found.select("vec_id", "label", (F.round("distance", 9) + 0.0).alias("distance"))


@register("nearest_per_query", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query, v.vec_id AS id, 1 - list_cosine_similarity(v.e, q.e) AS distance FROM v, v q WHERE q.vec_id % 100 = 0)
SELECT query, id, abs(round(distance, 9)) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), id) AS rank FROM d) WHERE rank <= 5""")
def nearest_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest_each(vectors, vectors.where("vec_id % 100 = 0"), 5)
    return found.select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), (F.abs(F.round("distance", 9)) + 0.0).alias("distance"), "rank")


_ALL_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query, v.vec_id AS id, round(1 - list_cosine_similarity(v.e, q.e), 12) AS distance FROM v, v q)
SELECT query, id, abs(round(distance, 9)) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5"""


@register("nearest_all", _ALL_SQL)
def nearest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector among all vectors, by blocks of queries and vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = blocks.nearest(vectors, vectors, 5)
    return found.select("query", "id", (F.abs(F.round("distance", 9)) + 0.0).alias("distance"), "rank")


@register("hash_embedding_norms", "SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '[a-z]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def hash_embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = texts(spark, sf_dir, "doc_id", "text").select("doc_id", retrieval.text_embedding(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.round(F.sqrt(retrieval.dot(F.col("v"), F.col("v"))), 9).alias("norm"))


@register("extractive_answer")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = texts(spark, sf_dir, "doc_id", "lang", "text").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.extractive_answer(chunks, "the reason that it was with the other")
