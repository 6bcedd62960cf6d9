"""op1: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import quality, sampling
from stancelake.llm.registry import register


def model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted to the documents outside the held-out third; their labels name the trusted positives."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = lambda rows, key: rows.where(sampling.fold(key, 3) != 1)
    positives = learn(sampling.agreed(labels, "quality"), "id").where("label = 1")
    return quality.train(learn(documents, "doc_id"), positives)


@register("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = quality.score(documents, model(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(sampling.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
