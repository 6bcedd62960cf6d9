"""Connected components of an edge table, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(rows: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not read again, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each is a grouped minimum, which
    combines before its shuffle, and a join on the node, which adaptive execution splits where a node is in
    very many edges. The edges of a round go to the checkpoint folder. Self-loops keep their node.
    """
    now = cut(_oriented(edges.select("a", "b")))
    seen = _mark(now)
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        mark = _mark(now)
        if mark == seen:
            roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        seen = mark
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node as a."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins neighbours to the least of a node's neighbours: its larger ones (large), or itself and its smaller ones."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(least, "b").select("a", "b", "m")
        joined = joined.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
    return _oriented(joined).where("a <> b")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)
