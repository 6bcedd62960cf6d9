"""op10: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import html
from stancelake.llm.registry import register


@register("op10_html")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = html.extract(pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
