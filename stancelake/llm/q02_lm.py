"""op2: every document scored by the mixing language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import mixing_lm, sampling
from stancelake.llm.registry import register


@register("op2_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(sampling.fold("doc_id", 7) == 2, F.lit(False))
    scored = mixing_lm.score(documents, ~held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        (F.col("score") / F.col("n_coded_bytes") / F.lit(-0.30102999566398120)).alias("bits_per_byte"),
    )
