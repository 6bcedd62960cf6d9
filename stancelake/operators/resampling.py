"""Bootstrap intervals over series of any length: replicates are sums kept by chunks of rows, and added up.

A replicate draws as many rows as there are, in circular blocks (blocks of one row: independently). Which chunk each of its
blocks begins in is split down a tree of chunks, and where in the chunk is drawn there; both from counters, so that
a chunk finds its own draws without those of others and the result does not depend on how rows are dealt. A chunk has the
rows that its blocks reach into behind it, and gives a row of sums for each replicate; Spark adds the chunks' rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.operators import scan

#: Rows of a chunk; starts that are drawn at once.
CHUNK, TOGETHER = 1 << 16, 1 << 20

#: Places of results that count: sums in another order differ beyond them.
PLACES = 12

SUMS = ("sx", "sy", "sxx", "syy", "sxy")

STATISTICS = ("correlation", "slope", "mean")


def _random(seed: int, *counters: int) -> np.random.Generator:
    """Numbers that depend on the seed and the counters only."""
    return np.random.Generator(np.random.Philox(key=np.array([seed, counters[0]], np.uint64), counter=np.array([0, 0, *counters[1:], *[0] * (3 - len(counters))], np.uint64)[:4]))


def draws_in(chunk: int, sizes_upto, chunks: int, each: int, draws: int, seed: int, kind: int) -> np.ndarray:
    """How many of the `each` blocks of every replicate begin in a chunk: binomial halves down the tree of chunks.

    sizes_upto: a function of the number of rows in the chunks before one.
    """
    count, low, high = np.full(draws, each, np.int64), 0, chunks
    while high - low > 1:
        middle = (low + high) // 2
        rows, left = sizes_upto(high) - sizes_upto(low), sizes_upto(middle) - sizes_upto(low)
        in_left = _random(seed, kind, low, high).binomial(count, left / rows)
        count, low, high = (in_left, low, middle) if chunk < middle else (count - in_left, middle, high)
    return count


def chunk_sums(x: np.ndarray, y: np.ndarray, chunk: int, n: int, size: int, block: int, draws: int, seed: int) -> np.ndarray:
    """(draws, 5) sums over the blocks of each replicate that begin in a chunk, whose rows and those behind it are x and y."""
    upto = lambda c: min(n, c * size)
    chunks, own = -(-n // size), upto(chunk + 1) - upto(chunk)
    running = np.concatenate([np.zeros((1, 5)), np.cumsum(np.stack([x, y, x * x, y * y, x * y], axis=1), axis=0)])
    out = np.zeros((draws, 5))
    whole, rest = divmod(n, block)
    for kind, each, length in ((0, whole, block), (1, int(rest > 0), rest)):
        if not each:
            continue
        count = draws_in(chunk, upto, chunks, each, draws, seed, 2 * kind)
        random, ends, at = _random(seed, 2 * kind + 1, chunk), np.cumsum(count), 0
        while at < draws:  # some replicates at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            starts = random.integers(0, own, int(count[at:to].sum()))
            of = np.repeat(np.arange(at, to), count[at:to])
            for k in range(5):
                out[:, k] += np.bincount(of, weights=running[starts + length, k] - running[starts, k], minlength=draws)
            at = to
    return out


def statistic_of(name: str, n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """The correlation, the slope of y on x, or the mean of x, from sums; 0 where a side is constant."""
    if name == "mean":
        return sx / n
    vx, vy, both = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n), sxy / n - (sx / n) * (sy / n)
    if name == "slope":
        return F.when(vx > 1e-15, both / vx).otherwise(0.0)
    spread = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.when(spread > 1e-15, both / spread).otherwise(0.0)


def intervals(rows: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str | None = "y", block: Column | int = 1, statistic: str = "correlation", draws: int = 2_000, seed: int = 0, tail: Column | float = 0.025, least: int = 3, inward: int = 0, chunk: int = CHUNK) -> DataFrame:
    """keys, value, low, high, n of each key's series: the statistic, and its interval over `draws` replicates.

    block: rows of a block, an expression that may use n and the keys; n at most, 1 for independent draws. low and
    high are the replicates at places floor(tail * draws) and floor((1 - tail) * draws) - inward, at most the last, in
    their order; tail may use the keys too. Rows with a null in x or y do not count; under `least` rows all three are the
    statistic itself, or 0 for one that needs two sides. Order decides which rows are neighbours, so give enough columns;
    null keys are a key. An empty table gives no rows. `rows` are read more than once: give ones that are kept.
    """
    if statistic not in STATISTICS:
        raise errors.InvalidInput(f"statistic is one of {STATISTICS}: {statistic!r}")
    both = rows.select(*keys, *[c for c in order if c not in keys], F.col(x).cast("double").alias("x_"), (F.col(y).cast("double") if y and statistic != "mean" else F.lit(0.0)).alias("y_")).where("x_ IS NOT NULL AND y_ IS NOT NULL")
    length = F.least(F.col("n_"), F.greatest(F.lit(1), block if isinstance(block, Column) else F.lit(block))).cast("long")
    known = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.avg("x_").alias("mx_"), F.avg("y_").alias("my_")).withColumn("n", F.col("n_")).withColumn("block_", length).drop("n")
    known = known.withColumn("size_", F.greatest(F.lit(chunk), F.col("block_")).cast("long")).withColumn("chunks_", F.ceil(F.col("n_") / F.col("size_")).cast("long"))
    named = known.select(*[F.col(k).alias(f"{k}_key") for k in keys], "n_", "mx_", "my_", "block_", "size_", "chunks_")
    placed = scan.numbered(both, keys, [F.col(c) for c in order if c not in keys] + [F.col("x_"), F.col("y_")], "place_")
    same = F.lit(True)
    for k in keys:
        same = same & placed[k].eqNullSafe(named[f"{k}_key"])
    full = (placed.join(named, same) if keys else placed.crossJoin(F.broadcast(named))).drop(*[f"{k}_key" for k in keys])
    # a row is in its own chunk and in those before it whose blocks reach it, also around the end
    own = F.floor((F.col("place_") - 1) / F.col("size_")).cast("long")
    near = F.array_distinct(F.array(*[F.pmod(own - k, F.col("chunks_")) for k in range(3)]))
    full = full.where(F.col("n_") >= least).select("*", F.explode(near).alias("chunk_")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("around_"))
    full = full.withColumn("at_", F.col("place_") - 1 - F.col("chunk_") * F.col("size_") + F.col("around_") * F.col("n_"))
    end = F.least(F.col("size_"), F.col("n_") - F.col("chunk_") * F.col("size_")) + F.col("block_") - 1
    full = full.where((F.col("at_") >= 0) & (F.col("at_") < end)).select(*keys, "chunk_", "at_", "n_", "size_", "block_", (F.col("x_") - F.col("mx_")).alias("x_"), (F.col("y_") - F.col("my_")).alias("y_"))
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)

    def replicate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at_")
        c, n, size, length = (int(group[name].iloc[0]) for name in ("chunk_", "n_", "size_", "block_"))
        sums = chunk_sums(group["x_"].to_numpy(), group["y_"].to_numpy(), c, n, size, length, draws, seed)
        out = pd.DataFrame(sums, columns=list(SUMS))
        out.insert(0, "draw", np.arange(draws, dtype=np.int32))
        for k in reversed(keys):
            out.insert(0, k, [group[k].iloc[0]] * draws)
        return out

    parts = full.groupBy(*keys, "chunk_").applyInPandas(replicate, f"{kinds}{', ' if keys else ''}draw int, {', '.join(f'{s} double' for s in SUMS)}")
    added = parts.groupBy(*keys, "draw").agg(*[F.sum(s).alias(s) for s in SUMS])
    total = both.join(named, _same(both, named, keys)) if keys else both.crossJoin(F.broadcast(named))
    dx, dy = F.col("x_") - F.col("mx_"), F.col("y_") - F.col("my_")
    whole = total.groupBy(*[both[k] for k in keys]).agg(F.first("n_").alias("n"), F.first("mx_").alias("mx_"), F.sum(dx).alias("sx"), F.sum(dy).alias("sy"), F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"), F.sum(dx * dy).alias("sxy"))
    of = lambda shift: statistic_of(statistic, F.col("n"), *[F.col(s) for s in SUMS]) + (shift if statistic == "mean" else F.lit(0.0))
    whole = whole.where(F.col("n") > 0).select(*keys, "n", "mx_", F.when((F.col("n") >= least) | F.lit(statistic == "mean"), of(F.col("mx_"))).otherwise(0.0).alias("value"))
    drawn = added.select(*[F.col(k).alias(f"{k}_drawn") for k in keys], *SUMS)
    joined = whole.join(drawn, _same(whole, drawn, keys, "_drawn"), "left") if keys else whole.crossJoin(drawn)
    # as many numbers as there are draws for each key
    sorted_ = F.sort_array(F.collect_list(F.when(F.col("sx").isNotNull(), of(F.col("mx_")))))
    out = joined.groupBy(*keys, "n", "value").agg(sorted_.alias("drawn_"))
    share = tail if isinstance(tail, Column) else F.lit(tail)
    low, high = F.floor(share * draws), F.least(F.floor((1 - share) * draws) - inward, F.lit(draws - 1))
    at = lambda place: F.coalesce(F.try_element_at("drawn_", (place + 1).cast("int")), F.col("value"))
    shown = [F.round(c, PLACES).alias(name) for name, c in (("value", F.col("value")), ("low", at(low)), ("high", at(high)))]
    return out.select(*keys, *shown, "n")


def _same(rows: DataFrame, named: DataFrame, keys: list[str], ending: str = "_key") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & rows[k].eqNullSafe(named[f"{k}{ending}"])
    return out
