"""Running sums and last values over keys of any size, in two levels: ranges of the order, then what each range carries on.

A window over a key is one task for all its rows. Here rows are dealt by ranges of (key, order), so that a hot key is cut
where it is long; each range is scanned on its own, and only the first key of a range can have begun in an earlier one.
So what is carried over is at most one row for each range, which is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake.session import checkpointed, unused


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, newest: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """`rows` with a column for each name of `sums` and `newest`.

    sums: the sum of the expression over the rows of the same `by` up to this one in `order`, null expressions left out, zero
    if there is none. newest: the expression's last value that is not null among them, null if there is none. Rows
    that are equal in `order` are taken in any order, so give enough columns. Nulls in `by` are a key of their own. An
    empty table stays empty. Names that are taken already are replaced.
    """
    sums, newest = sums or {}, newest or {}
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, nth = unused(rows, "part_"), unused(rows, "nth_")
    ranged = rows.repartitionByRange(parts, *by, *order).withColumn(part, F.spark_partition_id())
    inside = Window.partitionBy(part, *by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: F.sum(x).over(so_far) for name, x in sums.items()} | {name: F.last(x, ignorenulls=True).over(so_far) for name, x in newest.items()}
    # the numbers of ranges are part of what is kept: another run would cut elsewhere
    level = checkpointed(ranged.withColumns(found | {nth: F.row_number().over(inside)}))
    ends = level.groupBy(part, *by).agg(*[F.max_by(name, nth).alias(name) for name in found])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # of ranges, not of rows
    carried = [F.sum(name).over(earlier).alias(f"{name}_before") for name in sums] + [F.last(name, ignorenulls=True).over(earlier).alias(f"{name}_before") for name in newest]
    names = {c: unused(level, f"{c}_key") for c in [part, *by]}
    begun = F.lag(part).over(Window.partitionBy(*by).orderBy(part)).alias("begun")
    carry = ends.select(*[F.col(c).alias(k) for c, k in names.items()], *carried, begun).where("begun IS NOT NULL").drop("begun")
    same = reduce(lambda a, b: a & b, [level[c].eqNullSafe(F.col(k)) for c, k in names.items()])
    joined = level.join(F.broadcast(carry), same, "left")  # a row for each range at most
    out = {name: _added(name, level.schema[name].dataType) for name in sums} | {name: F.coalesce(F.col(name), F.col(f"{name}_before")) for name in newest}
    kept = [c for c in rows.columns if c not in out]
    return joined.select(*[level[c] for c in kept], *[x.alias(name) for name, x in out.items()])


def _added(name: str, kind: T.DataType) -> Column:
    """The sum in the range and that before it, in their own type: a sum of widest decimals would lose a place."""
    narrow = T.DecimalType(37, kind.scale) if isinstance(kind, T.DecimalType) and kind.precision == 38 else kind
    own, before = (F.coalesce(F.col(c), F.lit(0)).cast(narrow) for c in (name, f"{name}_before"))
    return (own + before).cast(kind)


def numbered(rows: DataFrame, by: list[str], order: list[Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """`rows` with their number from 1 within `by`, in `order`: a row_number whose keys may be of any size."""
    return running(rows, by, order, {out: F.lit(1).cast("long")}, parts=parts)
