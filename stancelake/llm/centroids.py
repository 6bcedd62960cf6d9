"""Exact centroid clustering of integer vectors, screened in single precision.

A round is one pass over the vectors. A task multiplies its vectors with the centroids in float32 and bounds the error
of each product, so that every squared distance is known to lie in an interval. Where one centroid's interval is below
all others the vector is decided; the centroids whose intervals overlap the lowest are computed again with integers,
and of equal distances the smallest number wins. Results are those of exact arithmetic, whatever the order of sums.

What leaves a task are sums for each centroid and component, so a round shuffles centroids x components numbers a task
and brings centroids x components to the driver. Nothing is kept between rounds but the centroids: a lost task is run
again from the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stancelake.llm import text

#: Integers beyond this would not leave room for a squared distance of 4,096 components in 64 bits.
MOST = 1 << 24

#: Rows that are multiplied at once, and pairs that are computed again at once.
ROWS, PAIRS = 1 << 14, 1 << 16

#: Half the distance from 1 to the next float32: the largest relative error of one rounding.
UNIT = 2.0**-24


def integers(batch: pa.RecordBatch, column: str, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that are kept, and their integers floor(scale * x) as rows of `size`.

    A vector is kept if it has exactly `size` components, none of which is null or not finite.
    """
    lists = batch.column(column)
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    values = lists.values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
    sized = (np.diff(offsets) == size) & lists.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sized)
    if not len(at):
        return at, np.zeros((0, size), np.int64)
    rows = x[offsets[at][:, None] + np.arange(size)]
    finite = np.isfinite(rows).all(axis=1)  # a null component is read as NaN
    scaled = np.floor(scale * rows[finite])
    if scaled.size and np.abs(scaled).max() > MOST:
        raise OverflowError(f"a component is over {MOST} after scaling; use a smaller scale")
    return at[finite], scaled.astype(np.int64)


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and its exact squared distance, and how many pairs were computed again.

    With n components, a float32 product v.c differs from the true one by at most g * |v| * |c|, g = (n + 2) u / (1 - (n + 2) u):
    n products and sums in any order, and one rounding of each factor. Norms are taken in float64 and widened by a
    millionth, which is far more than their own error. Integers cannot underflow, and MOST keeps them from overflow.
    """
    n, size = vectors.shape
    k = len(centroids)
    gamma = (size + 2) * UNIT / (1 - (size + 2) * UNIT)
    c32, c_sq = centroids.astype(np.float32), (centroids**2).sum(axis=1)
    c_len = np.sqrt(c_sq.astype(np.float64))
    nearest, again = np.empty(n, np.int64), 0
    for at in range(0, n, ROWS):
        part = vectors[at : at + ROWS]
        v_len = np.sqrt((part**2).sum(axis=1).astype(np.float64))
        middle = c_sq.astype(np.float64) - 2.0 * (part.astype(np.float32) @ c32.T).astype(np.float64)
        reach = 2.000002 * gamma * v_len[:, None] * c_len + 2.0**-50 * (c_sq.astype(np.float64) + np.abs(middle)) + 2.0**-50
        low, high = middle - reach, middle + reach
        open_ = low <= high.min(axis=1)[:, None]
        nearest[at : at + ROWS] = np.argmax(open_, axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        step = max(1, PAIRS // k)
        for b in range(0, len(unsure), step):
            rows = unsure[b : b + step]
            of, j = np.nonzero(open_[rows])
            again += len(j)
            exact = np.full((len(rows), k), np.iinfo(np.int64).max)
            exact[of, j] = ((part[rows[of]] - centroids[j]) ** 2).sum(axis=1)
            nearest[at + rows] = np.argmin(exact, axis=1)  # the first of equal ones
    return nearest, ((vectors - centroids[nearest]) ** 2).sum(axis=1) if n else np.zeros(0, np.int64), again


@dataclass(frozen=True)
class Clusters:
    """Final centroids, with the number of vectors and the exact sum of squared distances of each."""

    centroids: list[list[int]]
    counts: list[int]
    inertias: list[int]

    @property
    def inertia(self) -> int:
        return sum(self.inertias)


def seeds(vectors: DataFrame, k: int, size: int, scale: int, order: Column, vector: str = "embedding") -> list[list[int]]:
    """The k kept vectors that come first in `order`, an expression that is never null; ties by components.

    A task sends on only its own k first.
    """
    rows = vectors.select(order.alias("place"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[tuple] = []
        for batch in batches:
            at, whole = integers(batch, "v", size, scale)
            places = batch.column("place").take(pa.array(at, pa.int64())).to_pylist()
            bound = heapq.nsmallest(k, places)[-1:]
            first = sorted(first + [(p, whole[i].tolist()) for i, p in enumerate(places) if p <= bound[0]])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in first], batch_type), pa.array([v for _, v in first], pa.list_(pa.int64()))], ["place", "v"])

    kind = rows.schema["place"].dataType
    batch_type = to_arrow_type(kind)
    found = rows.mapInArrow(run, f"place {kind.simpleString()}, v array<bigint>")
    return [r["v"] for r in found.orderBy("place", "v").limit(k).collect()]


def _sums(vectors: DataFrame, centroids: list[list[int]], scale: int, vector: str) -> tuple[np.ndarray, list[int], list[int]]:
    """Exact sums, counts and sums of distances of each centroid's vectors: one pass, one small shuffle."""
    known, size = np.array(centroids, np.int64), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # components, then the count, then the distance of each centroid; Python integers do not overflow
        total = np.zeros((len(known), size + 2), object)
        for batch in batches:
            _, whole = integers(batch, "v", size, scale)
            for at in range(0, len(whole), ROWS):
                part = whole[at : at + ROWS]
                nearest, distance, _ = assign(part, known)
                for j in np.unique(nearest).tolist():
                    mine = nearest == j
                    total[j, :size] += part[mine].sum(axis=0)
                    total[j, size] += int(mine.sum())
                    total[j, size + 1] += sum(distance[mine].tolist())
        of, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(place, pa.int32()), pa.array([str(x) for x in total[of, place]])], ["cluster", "place", "value"])

    parts = vectors.select(F.col(vector).alias("v")).mapInArrow(run, "cluster int, place int, value string")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value")).collect()
    table = np.zeros((len(known), size + 2), object)
    for r in found:
        table[r["cluster"], r["place"]] = int(r["value"])
    return table[:, :size], [int(x) for x in table[:, size]], [int(x) for x in table[:, size + 1]]


def fit(vectors: DataFrame, first: list[list[int]], rounds: int = 10, scale: int = 1024, vector: str = "embedding") -> Clusters:
    """`rounds` times: assign every vector, then move each centroid that has any to the floor of its vectors' mean.

    A centroid without vectors stays. Then vectors are counted and their distances summed once more. Stops early
    where no centroid moves, as all further rounds would be alike. Without vectors there are no centroids.
    """
    now = [list(map(int, c)) for c in first]
    if not now:
        return Clusters([], [], [])
    for _ in range(rounds):
        sums, counts, inertias = _sums(vectors, now, scale, vector)
        moved = [[x // n for x in row] if n else old for row, n, old in zip(sums.tolist(), counts, now)]
        if moved == now:
            return Clusters(now, counts, inertias)
        now = moved
    _, counts, inertias = _sums(vectors, now, scale, vector)
    return Clusters(now, counts, inertias)


def assigned(vectors: DataFrame, clusters: Clusters, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", carry: bool = False) -> DataFrame:
    """(id, cluster, distance) of every kept vector, and with `carry` a struct `row` of all columns, whatever their names.

    Vectors that are null, of another size, or with a component that is null or not finite are not kept; ids may be null
    or repeat, and every row has a row of its own. Equal vectors have equal results; of centroids at equal distance, also
    of equal centroids, the smallest number is taken. An empty table gives no rows. A component over MOST after
    scaling is an error, as squared distances would not be 64-bit integers.
    """
    known = np.array(clusters.centroids, np.int64).reshape(-1, size)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *([F.struct("*").alias("row")] if carry else []))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v"] + ["cluster int", "distance bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = integers(batch, "v", size, scale)
            if len(at):
                nearest, distance, _ = assign(whole, known)
                left = [batch.column(c).take(pa.array(at)) for c in batch.schema.names if c != "v"]
                yield pa.RecordBatch.from_arrays([*left, pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], [*(c for c in batch.schema.names if c != "v"), "cluster", "distance"])

    out = rows.mapInArrow(run, ", ".join(kinds))
    name = text.free_name(["cluster", "distance", "row"], id_col)
    return out.select(F.col("id").alias(name), "cluster", "distance", *(["row"] if carry else []))
