"""op6: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import sampling, toxicity
from stancelake.llm.registry import register


def model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted to all labelled documents outside the held-out fifth."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train_whole(documents, sampling.agreed(labels, "toxic").where(sampling.fold("id", 5) != 0).where("label IN (0, 1)"))


@register("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity.score(documents, model(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(sampling.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
