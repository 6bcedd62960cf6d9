"""A stored approximate index of vectors: lists in folders, of which a search reads only those that it probes.

Every vector is in the list of its nearest centre. A list is a partition folder, so a search joins the stored table with the
lists that it probes and Spark prunes the folders by that join before it reads. New vectors are added to their lists as a
batch of their own; where they lie further from the centres than those that the centres were fitted to, the index is
fitted anew. All changes are snapshots, so a search meets an index that is whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake import errors, session
from stancelake.operators import blocks, retrieval, snapshots, speeches

CENTRES, LISTS = "centres", "lists"

#: The list of zero vectors, which are at the same distance of everything: every search reads it.
ZERO = -1


class ListIndex:
    """The index under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, snapshots.Tables(spark, root)

    def _centres(self, number: int | None = None) -> tuple[np.ndarray, float]:
        """Centres in order of their lists, and the mean distance of vectors to their centres when they were fitted."""
        rows = self.tables.read(CENTRES, number).orderBy("list").collect()  # one row for each list
        return np.array([r["centre"] for r in rows]), rows[0]["spread"]

    @staticmethod
    def _vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def _listed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """id, v, list; rows of a list are dealt to several files where there are many."""
        zero = ~F.exists("v", lambda x: x != 0)
        listed = rows.withColumn("list", F.when(zero, F.lit(ZERO)).otherwise(speeches.lists_of(F.col("v"), centres)[0]))
        return listed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))

    def _spread(self, rows: DataFrame, centres: np.ndarray) -> float:
        """Mean distance of vectors to their centres."""
        table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
        return rows.where(F.col("list") != ZERO).agg(F.avg(retrieval.cosine_distance(F.col("v"), F.element_at(table, F.col("list") + 1)))).first()[0] or 0.0

    def _fitted(self, rows: DataFrame, n: int, most: int, seed: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
        centres = speeches.centroids(rows.where(F.exists("v", lambda x: x != 0)), n, most, seed=seed, vector="v")
        listed = self._listed(rows, centres)
        spread = self._spread(listed, centres)
        table = self.spark.createDataFrame([(k, [float(x) for x in c], float(spread)) for k, c in enumerate(centres)], "list int, centre array<double>, spread double")
        return table, centres, listed

    def create(self, rows: DataFrame, lists: int = 64, most: int = 20_000, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding") -> int:
        """Fits the centres to at most `most` vectors, the documented bound, and stores all of them; the snapshot's number.

        Rows without id or vector are not stored. A table without a vector that is not zero is InsufficientData.
        """
        table, _, listed = self._fitted(self._vectors(rows, id_col, vector), lists, most, seed)
        return self.tables.publish({CENTRES: table, LISTS: listed}, "fit-1", {LISTS: ["list"]}).number

    def append(self, rows: DataFrame, batch: str, id_col: str = "vec_id", vector: str = "embedding") -> int:
        """Adds a batch of vectors to their lists. A batch of that name that is there already is an ImmutableRecord."""
        if not self.tables.snapshot().tables:
            raise errors.InsufficientData("create the index before vectors are added to it")
        centres, _ = self._centres()
        return self.tables.publish({LISTS: self._listed(self._vectors(rows, id_col, vector), centres)}, batch, {LISTS: ["list"]}).number

    def drift(self) -> float:
        """How many times further from their centres vectors now lie, on average, than when the centres were fitted."""
        centres, fitted = self._centres()
        now = self._spread(self.tables.read(LISTS), centres)
        return now / fitted if fitted else (1.0 if not now else float("inf"))

    def refit(self, lists: int = 64, most: int = 20_000, seed: int = 3, drifted: float = 1.0) -> bool:
        """Fits centres anew and puts all vectors into their lists, if drift() is at least `drifted`; whether it did.

        ImmutableRecord if vectors were added meanwhile; older snapshots can still be searched.
        """
        if self.drift() < drifted:
            return False
        base = self.tables.snapshot()
        rows = self.tables.read(LISTS, base.number).select("id", "v")
        table, _, listed = self._fitted(rows, lists, most, seed)
        self.tables.replace({CENTRES: table, LISTS: listed}, f"fit-{base.number + 1}", base, {LISTS: ["list"]})
        return True

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, id_col: str = "vec_id", vector: str = "embedding", snapshot: int | None = None, parts: int | None = None) -> DataFrame:
        """query, id, distance, rank: of each query the k nearest vectors in the `probes` lists nearest to it.

        Exact where all lists are probed. Distances and ties are those of blocks.nearest. A query that is zero probes the
        first lists. Before anything is stored there are no rows. Only folders of probed lists are read.
        """
        asked = self._vectors(queries, id_col, vector)
        if not self.tables.snapshot(snapshot).tables:
            return self.spark.createDataFrame([], f"query {asked.schema['id'].dataType.simpleString()}, id {asked.schema['id'].dataType.simpleString()}, distance double, rank int")
        centres, _ = self._centres(snapshot)
        near = F.concat(F.array(F.lit(ZERO)), speeches.lists_of(F.col("v"), centres, probes))
        asked = session.checkpointed(asked.select("id", "v", near.alias("near"))).select("id", "v", F.explode("near").alias("list"))
        probed = asked.select("list").distinct().where(F.col("list") >= ZERO)  # no more rows than there are lists
        stored = self.tables.read(LISTS, snapshot).join(F.broadcast(probed), "list", "left_semi")
        return blocks.in_lists(stored.select("list", "id", "v"), asked, k, parts)

    def count(self, snapshot: int | None = None) -> int:
        """Vectors in a snapshot."""
        return self.tables.read(LISTS, snapshot).count() if self.tables.snapshot(snapshot).tables else 0

