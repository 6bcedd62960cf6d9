"""From raw documents to a training manifest: classify, clean, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the docs of the next. All stages but the last return the columns of documents, whatever others there are; the
last returns what to take of each document. Null texts count as empty in every stage, and so are one class of
near copies; repeated rows are judged alike, and of those the third stage keeps one, but all rows without id. An
empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import decontaminate, graph, q01_quality, q03_mixture, q06_toxicity, quality, simhash, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.5 or more."""
    return docs.where(quality.probability(q01_quality.model(spark, sf_dir))(F.col("text")) >= 0.5)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier scores under 0.5."""
    return docs.where(toxicity.probability(q06_toxicity.model(spark, sf_dir), spark)(F.col("text")) < 0.5)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs, benchmark, carry=True)
    return found.where(F.size("spans") == 0).select("row.*")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mixture to target weights takes of each document; documents that it takes nothing of go."""
    return q03_mixture.mixed(docs).where("taken_tokens > 0")


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing to target weights", to_weights),
]

#: The classifiers are trained; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, through Parquet in the shared folder."""
    folder = f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """What a stage has read is not read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
