"""op5: SimHash classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import simhash
from stancelake.llm.registry import register


@register("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash.classes(documents, size=3, bits=64, radius=3)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))
