"""Bounded, reproducible samples of labelled rows, and fold columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm import text


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)).cast("int")


def agreed(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the ids whose label rows all say the same; null ids and labels do not count."""
    return (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("id", "label")
    )


def about(rows: DataFrame, columns: list[str], most: int, seed: int, known: int | None = None) -> DataFrame:
    """At most `most` rows: all of them if there are no more, else those with the least seeded hashes of `columns`.

    A threshold on the 64-bit hash keeps about an eighth more than are wanted before anything is ordered. Rows that
    are equal in `columns` have one hash and are drawn once, so no hot value, null too, fills the sample.
    """
    n = rows.count() if known is None else known
    if n <= most:
        return rows
    place = F.xxhash64(F.lit(seed), *columns)
    bound = min(2**63 - 1, -(2**63) + (most + most // 8 + 64) * 2**64 // n)
    name = text.free_name(rows.columns, "place")
    drawn = rows.where(place < F.lit(bound)).withColumn(name, place).dropDuplicates([name])
    return drawn.orderBy(name).limit(most).drop(name)


def one_each(rows: DataFrame, id_col: str, *values: str) -> DataFrame:
    """One row (id, *values) for each id: of rows that share one, that with the least hash of the values."""
    kept = F.min_by(F.struct(*values), F.xxhash64(*values))
    return rows.groupBy(id_col).agg(kept.alias("kept")).select(id_col, "kept.*")
