"""Where a committee stood at a point in time, and who had moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancelake.operators import scan


def movement(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per asked point (ask, bank, as_of) and member of the bank heard by then.

    Columns: ask, bank, member, score, previous, delta, readings, place. Later readings do not count, and a
    member counts only once heard. place: members with a change first, the largest first, then by name.

    Points are put into the timeline of each member of their bank, and each carries on the reading before it, so
    the cost is the readings and the rows of the result, not points times readings.
    """
    of_member = Window.partitionBy("bank", "member").orderBy("ts", "id")
    readings = rows.select("bank", "member", "ts", "id", "score").withColumn("previous", F.lag("score").over(of_member)).withColumn("readings", F.row_number().over(of_member).cast("long"))
    readings = readings.select("bank", "member", "ts", F.lit(0).alias("kind"), "id", F.lit(None).cast(asked.schema["ask"].dataType).alias("ask"), F.struct("score", "previous", "readings").alias("now"))
    members = rows.select("bank", "member").distinct()
    points = asked.select("ask", "bank", F.col("as_of").alias("ts")).join(members, "bank")
    points = points.select("bank", "member", "ts", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "ask", F.lit(None).cast(readings.schema["now"].dataType).alias("now"))
    so_far = Window.partitionBy("bank", "member").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = readings.unionByName(points).withColumn("now", F.last("now", ignorenulls=True).over(so_far)).where("kind = 1 AND now IS NOT NULL").select("ask", "bank", "member", "now.*")
    pairs = pairs.withColumn("delta", F.col("score") - F.col("previous"))
    order = Window.partitionBy("ask").orderBy(F.col("delta").isNull(), F.desc(F.abs("delta")), F.lower(F.col("member").cast("string")))
    return pairs.withColumn("place", F.row_number().over(order))


def summary(moved: DataFrame, band: float = 0.02) -> DataFrame:
    """ask, bank, standing, overall_move, members, with_change, movers of each asked point."""
    return moved.groupBy("ask", "bank").agg(F.avg("score").alias("standing"), F.avg("delta").alias("overall_move"), F.count(F.lit(1)).alias("members"), F.count("delta").alias("with_change"), F.count_if(F.abs("delta") > band).alias("movers"))


def every_summary(rows: DataFrame, band: float = 0.02) -> DataFrame:
    """The columns of summary for every reading as an asked point, whose id is ask; points of one instant are alike.

    A reading changes only what its own member adds to the bank's figures, so these are running sums of changes. The
    changes of a bank's instant are summed first; the sums run in two levels, so that no task has a whole bank. Sums are
    decimal. Windows are only over one member.
    """
    by_member = Window.partitionBy("bank", "member").orderBy("ts", "id")
    known = rows.select("bank", "member", "ts", "id", "score").withColumn("previous", F.lag("score").over(by_member)).withColumn("nth", F.row_number().over(by_member))
    known = known.withColumn("delta", F.col("score") - F.col("previous")).withColumn("old", F.lag("delta").over(by_member))
    exact = lambda c: F.coalesce(F.col(c).cast("decimal(18,10)"), F.lit(0).cast("decimal(18,10)"))
    there = lambda c: F.col(c).isNotNull().cast("long")
    moved = lambda c: F.coalesce((F.abs(c) > band).cast("long"), F.lit(0))
    changes = {
        "total": exact("score") - exact("previous"), "scored": there("score") - there("previous"), "change": exact("delta") - exact("old"),
        "members": (F.col("nth") == 1).cast("long"), "with_change": there("delta") - there("old"), "movers": moved("delta") - moved("old"),
    }
    instants = known.groupBy("bank", "ts").agg(*[F.sum(c).alias(name) for name, c in changes.items()])
    standing = scan.running(instants, ["bank"], [F.col("ts")], {name: F.col(name) for name in changes})
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))
    asked = rows.select(F.col("id").alias("ask"), "bank", "ts").join(standing, ["bank", "ts"])
    return asked.select("ask", "bank", mean("total", "scored").alias("standing"), mean("change", "with_change").alias("overall_move"), "members", "with_change", "movers")
