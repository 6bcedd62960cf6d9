"""As-of joins: to each row the other table's last row before it, its first after it, or the nearer of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake import errors
from stancelake.operators import scan

DIRECTIONS = ("backward", "forward", "nearest")


def _moment(column: str, kind: T.DataType) -> Column:
    """Times as microseconds, numbers as they are."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: dict[str, str] | None = None, tie: str | None = None, direction: str = "backward", strict: bool = False, within: float | None = None, out: str = "match", parts: int | None = None) -> DataFrame:
    """Every row of `left` with a struct `out` of one row of `right`, null where none matches.

    by: names of key columns of `left` and theirs in `right`; none: all rows are of one key. backward: the last row by
    (right_on, tie) at or before left_on; forward: the first at or after it; nearest: the nearer, the earlier if both
    are as near. strict: rows at the same moment do not match. within: seconds (times) or units (numbers) that a
    match may be away, that distance included. Null keys and null moments match nothing. Rows of `left` that repeat
    are all kept; of rows of `right` that are equal in moment and tie any one is taken.

    Both tables are dealt by ranges of key and time and scanned in two levels, so a key may hold any share of the rows
    and the cost does not depend on how many rows lie between two matches.
    """
    if direction not in DIRECTIONS:
        raise errors.InvalidInput(f"direction is one of {DIRECTIONS}: {direction!r}")
    if direction == "nearest":
        before = as_of(left, right, left_on, right_on, by, tie, "backward", strict, within, "before", parts)
        rows = before.select(F.struct(*left.columns).alias("own"), "before", F.col(left_on).alias("at"), *[F.col(c).alias(f"key{i}") for i, c in enumerate(by or {})])
        both = as_of(rows, right, "at", right_on, {f"key{i}": c for i, c in enumerate((by or {}).values())}, tie, "forward", strict, within, "after", parts)
        at = _moment("at", left.schema[left_on].dataType)
        gap = lambda side: F.abs(_moment(f"{side}.{right_on}", right.schema[right_on].dataType) - at)
        nearer = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
        return both.select("own.*", nearer.alias(out))
    by = by or {}
    forward = direction == "forward"
    here, there = _moment(left_on, left.schema[left_on].dataType), _moment(right_on, right.schema[right_on].dataType)
    kind = right.schema[tie].dataType if tie else T.IntegerType()
    keys = [f"k{i}" for i in range(len(by))]
    # at one moment, rows of the other table come first, unless they must not match
    mine = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], here.alias("t"), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(kind).alias("tie"), F.struct(*left.columns).alias("own"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("s")).schema["s"].dataType).alias("other"))
    other = right.select(*[F.col(c).alias(k) for c, k in zip(by.values(), keys)], there.alias("t"), F.lit(1 if strict else 0).alias("side"), (F.col(tie) if tie else F.lit(0)).cast(kind).alias("tie"), F.lit(None).cast(mine.schema["own"].dataType).alias("own"), F.struct(*right.columns).alias("other"))
    for column in ("t", *keys):
        other = other.where(F.col(column).isNotNull())
    order = [F.col("t").desc_nulls_first(), F.col("side"), F.col("tie").desc_nulls_first()] if forward else [F.col("t").asc_nulls_first(), F.col("side"), F.col("tie").asc_nulls_first()]
    found = scan.running(mine.unionByName(other), keys, order, newest={"other": F.col("other")}, parts=parts).where(F.col("own").isNotNull())
    match = F.col("other")
    if within is not None:
        unit = 1_000_000 if isinstance(left.schema[left_on].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else 1
        match = F.when(F.abs(F.col("t") - _moment(f"other.{right_on}", right.schema[right_on].dataType)) <= within * unit, match)
    return found.select("own.*", match.alias(out))
