"""The k nearest vectors of each of many queries: products of blocks in tasks, the best of each block merged.

Vectors and queries are dealt to cells of a grid; a task holds the queries of a cell and multiplies the vectors
that stream past with them, keeping k of each query. A side is scanned once and no part of it goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to all tasks at once, and queries of one cell of a grid, at most.
HELD, OF_CELL = 1 << 14, 1 << 16

#: Queries and vectors multiplied at once.
ROWS, COLUMNS = 1024, 2048

#: Places of a distance that count; the rest is rounding, and ids decide.
PLACES = 12


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none null, as rows of length one; zero vectors stay zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as numbers or as strings."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


class Best:
    """The k nearest ids of each of some queries among the vectors that were shown; of equal distances the least ids.

    Products are made for ROWS queries and COLUMNS vectors at once; of those only what is no further than the k known is sorted.
    """

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, k: int):
        self.queries, self.vectors, self.k = queries, vectors, k
        self.distances, self.ids = np.full((len(queries), k), np.inf), None

    def show(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids) or not len(self.queries):
            return
        if self.ids is None:
            self.ids = np.zeros((len(self.queries), self.k), ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))  # longer strings
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        for row in range(0, len(ids), COLUMNS):
            for at in range(0, len(self.queries), ROWS):
                self._show(at, ids[row : row + COLUMNS], rows[row : row + COLUMNS])

    def _show(self, at: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """ids in ascending order."""
        known = self.distances[at : at + ROWS]
        distance = 1.0 - self.vectors[at : at + ROWS] @ rows.T
        worst, take = known[:, -1:], min(self.k, len(ids))
        if np.isinf(worst).any():
            worst = np.minimum(worst, np.partition(distance, take - 1, axis=1)[:, take - 1 : take])
        near = distance <= worst + 2 * 10.0**-PLACES
        many = np.flatnonzero(near.sum(axis=1) > 8 * self.k)
        for q in many:  # equal distances: ids are in order, so the first are the least
            first = np.argsort(np.round(distance[q], PLACES), kind="stable")[: self.k]
            near[q] = False
            near[q, first] = True
        of, row = np.nonzero(near)
        if not len(of):
            return
        touched = np.unique(of)
        old = np.repeat(touched, self.k)
        all_of = np.concatenate([old, of])
        distances = np.concatenate([known[touched].ravel(), np.round(distance[of, row], PLACES)])
        found = np.concatenate([self.ids[at + touched].ravel(), ids[row]])
        order = np.lexsort((found, distances, all_of))
        all_of, distances, found = all_of[order], distances[order], found[order]
        kept = np.arange(len(all_of)) - np.searchsorted(all_of, all_of) < self.k  # of each query there are k at least
        known[touched] = distances[kept].reshape(-1, self.k)
        self.ids[at + touched] = found[kept].reshape(-1, self.k)

    def batches(self, kinds: tuple[pa.DataType, pa.DataType], together: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        """query, id, distance of what was found, `together` queries at once."""
        for at in range(0, len(self.queries) if self.ids is not None else 0, together):
            of, n = np.nonzero(np.isfinite(self.distances[at : at + together]))
            columns = [self.queries[at + of], self.ids[at + of, n], self.distances[at + of, n]]
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist() if x.dtype.kind == "U" else x, t) for x, t in zip(columns, (*kinds, pa.float64()))], ["query", "id", "distance"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """query, id, distance, rank of the k nearest of each query among rows of several tasks."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kinds(vectors: DataFrame, queries: DataFrame) -> tuple[str, tuple]:
    from pyspark.sql.pandas.types import to_arrow_type

    q, v = queries.schema["id"].dataType, vectors.schema["id"].dataType
    return f"query {q.simpleString()}, id {v.simpleString()}, distance double", (to_arrow_type(q), to_arrow_type(v))


def in_cells(vectors: DataFrame, queries: DataFrame, cell: list[str], k: int, parts: int) -> DataFrame:
    """query, id, distance of the k nearest vectors of each query within each cell.

    vectors and queries: id, v and the columns of `cell`. A task gets the queries of a cell first and holds them.
    """
    schema, kinds = _kinds(vectors, queries)
    # floats stay floats in the shuffle; tasks multiply doubles
    wide = "array<float>" if all(x.schema["v"].dataType.simpleString() == "array<float>" for x in (vectors, queries)) else "array<double>"
    both = queries.select(*cell, F.lit(0).alias("side"), F.col("id").alias("query"), F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.col("v").cast(wide).alias("v"))
    both = both.unionByName(vectors.select(*cell, F.lit(1).alias("side"), F.lit(None).cast(queries.schema["id"].dataType).alias("query"), "id", F.col("v").cast(wide).alias("v")))
    dealt = both.repartition(parts, *cell).sortWithinPartitions(*cell, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best = None, [], None

        def opened() -> Best:
            whole = pa.Table.from_batches(waiting)
            return Best(ids_of(whole.column("query").combine_chunks()), matrix(whole.column("v").combine_chunks()), k)

        for batch in batches:
            # runs of one cell and one side
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*cell, "side")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                key, part = tuple(keys[:-1, a].tolist()), batch.slice(a, b - a)
                if key != now:
                    if best is not None:
                        yield from best.batches(kinds)
                    now, waiting, best = key, [], None
                if keys[-1, a] == 0:
                    waiting.append(part)
                elif waiting:
                    if best is None:
                        best, waiting = opened(), waiting[:1]
                    best.show(ids_of(part.column("id")), matrix(part.column("v")))
        if best is not None:
            yield from best.batches(kinds)

    return dealt.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, held: int = HELD, parts: int | None = None) -> DataFrame:
    """query, id, distance, rank of the k nearest rows of `vectors` (id, v) of every row of `queries` (id, v), exactly.

    Distances are one minus the cosine, at PLACES places; of equal ones the least ids come first. A zero vector is at
    distance 1 of all. Rows without id or vector do not count; ids are whole numbers or strings, and distinct. Up to
    `held` queries go to all tasks that read vectors, and no vector moves. More are cut into groups, and queries and
    vectors are dealt to the cells of a grid that has about `parts` cells, twice the cores if not given, and is as
    nearly square as it can be: a row is shuffled as often as the grid has cells on a side. Only where a group would be over
    OF_CELL queries are there more groups than that. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    vectors, queries = (x.where("id IS NOT NULL AND v IS NOT NULL") for x in (vectors, queries))
    n = queries.count()
    if n <= held:
        table = queries.select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast((ids_of(table.column("id").combine_chunks()), matrix(table.column("v").combine_chunks())) if n else (np.zeros(0, np.int64), np.zeros((0, 1))))
        schema, kinds = _kinds(vectors, queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*sent.value, k)
            for batch in batches:
                best.show(ids_of(batch.column("id")), matrix(batch.column("v")))
            yield from best.batches(kinds)

        return merged(vectors.select("id", "v").mapInArrow(run, schema), k)
    parts = parts or 2 * spark.sparkContext.defaultParallelism
    groups = max(math.isqrt(max(1, parts - 1)) + 1, -(-n // OF_CELL))
    bands = -(-parts // groups)
    deal = lambda name, m: F.pmod(F.xxhash64(name), F.lit(m)).cast("int")
    spine = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    v = vectors.select("id", "v", deal("id", bands).alias("band"), spine(groups).alias("grp"))
    q = queries.select("id", "v", deal("id", groups).alias("grp"), spine(bands).alias("band"))
    return merged(in_cells(v, q, ["band", "grp"], k, groups * bands), k)


def in_lists(vectors: DataFrame, queries: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """query, id, distance, rank of the k nearest vectors (list, id, v) of each query among those of its lists (list, id, v).

    A list is dealt to a grid of cells, the more the more products it takes, about `parts` cells in all beside one for
    each list; twice the cores if not given. So a large list is many tasks and a small one is not sent to many. Distances and ties
    are those of nearest().
    """
    spark = vectors.sparkSession
    vectors, queries = (x.where("id IS NOT NULL AND v IS NOT NULL") for x in (vectors, queries))
    parts = parts or 2 * spark.sparkContext.defaultParallelism
    sizes = [{r["list"]: r["count"] for r in x.groupBy("list").count().collect()} for x in (vectors, queries)]  # a row for each list
    work = {x: n * sizes[1][x] for x, n in sizes[0].items() if x in sizes[1]}
    grids = []
    for x, products in work.items():
        cells = -(-products * parts // sum(work.values()))
        groups = max(math.isqrt(max(0, cells - 1)) + 1, -(-sizes[1][x] // OF_CELL))
        grids.append((x, groups, -(-cells // groups)))
    table = F.broadcast(spark.createDataFrame(grids, "list int, groups int, bands int"))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    spine = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    v = vectors.join(table, "list").select("list", "id", "v", deal("bands").alias("band"), spine("groups").alias("grp"))
    q = queries.join(table, "list").select("list", "id", "v", deal("groups").alias("grp"), spine("bands").alias("band"))
    return merged(in_cells(v, q, ["list", "band", "grp"], k, max(1, sum(g * b for _, g, b in grids))), k)
