"""Idempotent ingestion: unseen rows, append-only writes, upserts, validation with rejects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from stancelake import session
from stancelake.functions.text import sha256
from stancelake.operators import snapshots


def first_of_text(rows: DataFrame, text: str = "text", order: str = "doc_id", out: str = "source_sha256") -> DataFrame:
    """The first row of each text by `order`, nulls last, with its hash; null texts are one text, the empty one.

    Hashes and order keys are combined before they meet in a shuffle; the rows are picked by a null-safe semi join,
    and of several rows with one text and key any one stays.
    """
    hashed = rows.withColumn(out, sha256(F.coalesce(F.col(text), F.lit(""))))
    first = hashed.groupBy(F.col(out).alias("h")).agg(F.min(order).alias("k"))
    return hashed.join(first, (F.col(out) == F.col("h")) & F.col(order).eqNullSafe(F.col("k")), "left_semi").dropDuplicates([out])


def unseen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored: an anti join, to be put before anything costly."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def known(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are stored."""
    return rows.join(stored.select(*keys), keys, "left_semi")


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Adds rows to a Parquet table. There is no counterpart that changes or removes rows of it."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def ingest(rows: DataFrame, path: str, spark: SparkSession | None = None, text: str = "text", order: str = "doc_id") -> int:
    """Appends the rows whose text is not in the table at `path` yet, each text once; the number appended."""
    spark = spark or rows.sparkSession
    fresh = first_of_text(rows, text, order)
    if session.holds_rows(spark, path):
        fresh = unseen(fresh, spark.read.parquet(path).select("source_sha256"), ["source_sha256"])
    seen = Observation(f"appended-{uuid.uuid4().hex}")
    append(fresh.observe(seen, F.count(F.lit(1)).alias("n")), path)  # counted as they are written, not in a second run
    return seen.get["n"]


def publish(tables: dict[str, DataFrame], root: str, batch: str) -> int:
    """Adds a batch to several tables at once; the number of the snapshot that has it. See snapshots.Tables.

    A write that fails half-way leaves nothing that can be read, and the batch may be published again; one that is
    published already is an ImmutableRecord.
    """
    spark = next(iter(tables.values())).sparkSession
    return snapshots.Tables(spark, root).publish(tables, batch).number


def published(spark: SparkSession, root: str, name: str, snapshot: int | None = None) -> DataFrame:
    """The rows of a table in a snapshot, the newest if none is named."""
    return snapshots.Tables(spark, root).read(name, snapshot)


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of both, the fresh one where a key is in both. Keys of `fresh` are distinct."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def ensure(rows: DataFrame, stored: DataFrame, natural: list[str], id_col: str = "id") -> DataFrame:
    """The stored keys and the new distinct ones; a new id is the hash of the natural key."""
    fresh = unseen(rows.select(*natural).distinct(), stored, natural)
    return stored.select(id_col, *natural).unionByName(fresh.select(sha256(F.concat_ws("\x1f", *natural)).alias(id_col), *natural))


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rejected rows have `reasons`, the names of all rules that do not hold; null does not hold."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    checked = rows.withColumn("reasons", reasons)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def limited(rows: DataFrame, accepted: Column, most: int, order: str) -> DataFrame:
    """The first `most` accepted rows by `order`: the limit counts accepted rows, not rows read."""
    return rows.where(accepted).orderBy(order).limit(most)


def pending(rows: DataFrame, done: DataFrame, key: str, bank: str | None = None, most: int | None = None) -> DataFrame:
    """Rows still to be scored, of one bank if named, at most `most` by key."""
    left = unseen(rows if bank is None else rows.where(F.col("bank") == bank), done, [key])
    return left if most is None else left.orderBy(key).limit(most)


def newest_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first in `order`."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")
