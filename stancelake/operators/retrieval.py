"""Nearest chunks by cosine distance, and answers made of their sentences."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake.functions import text
from stancelake.operators import blocks


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column, unit: bool = False) -> Column:
    """1 - cosine; with `unit` both are taken to be of length one. A zero vector is at distance 1."""
    if unit:
        return F.lit(1.0) - dot(a, b)
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def normalised(vector: Column) -> Column:
    """The vector at length one; a zero vector as it is."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def nearest(chunks: DataFrame, query: list[float], k: int = 5, most: float | None = None, only: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", unit: bool = False) -> DataFrame:
    """The k nearest rows with their distance; ties by id. `only` filters before, `most` cuts distances after the k."""
    rows = chunks if only is None else chunks.where(only)
    q = F.lit([float(x) for x in query])
    found = rows.withColumn("distance", cosine_distance(F.col(vector), q, unit)).orderBy(F.round("distance", 12), id_col).limit(k)
    return found if most is None else found.where(F.col("distance") <= most)


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = blocks.HELD) -> DataFrame:
    """query, id, distance, rank of the k nearest rows of every row of `queries`, exactly; see blocks.nearest."""
    wanted, rows = (x.select(F.col(id_col).alias("id"), F.col(vector).alias("v")) for x in (queries, chunks))
    return blocks.nearest(rows, wanted, k, block)


#: Eight bytes for a gram: blake2b of that size, or the first of md5, which SQL engines have too.
DIGESTS = {"blake2b": lambda raw: hashlib.blake2b(raw, digest_size=8).digest(), "md5": lambda raw: hashlib.md5(raw, usedforsecurity=False).digest()[:8]}


#: Hashes of grams that a worker keeps at once.
KEPT = 1 << 18


class _Places(dict):
    """gram -> twice its place, and one more if its sign is plus; made where it is not known."""

    def __init__(self, dim: int, digest: str):
        self.dim, self.eight = dim, DIGESTS[digest]

    def __missing__(self, gram: str) -> int:
        h = int.from_bytes(self.eight(gram.encode()), "big")
        self[gram] = code = h % self.dim * 2 + (h >> 33 & 1)
        return code


def gram_hasher(dim: int, digest: str = "blake2b"):
    """A function of a list of grams: the vector of hash_embedding; its `many` takes a list of lists and gives the vectors as rows.

    Hashes of grams seen are kept, up to about KEPT.
    """
    places = _Places(dim, digest)

    def many(lists) -> np.ndarray:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter((places[g] for grams in lists for g in grams), np.int64, int(sizes.sum()))
        if len(places) > KEPT:
            places.clear()
        at = np.repeat(np.arange(len(lists)), sizes) * dim + (codes >> 1)
        out = np.bincount(at, weights=(codes & 1) * 2.0 - 1.0, minlength=len(lists) * dim).reshape(len(lists), dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))  # sums of whole numbers
        return out / np.where(length > 0, length, 1.0)

    def one(grams) -> np.ndarray:
        return many([list(grams)])[0]

    one.many = many
    return one


def vectors_of(column: pa.Array, grams: Callable, one, dim: int, kind: type = np.float64) -> np.ndarray:
    """The vectors of all rows of a column, made a step at a time; `grams` gives the grams of a value."""
    out = np.zeros((len(column), dim), kind)
    for a, b in text.steps(column):
        for at in range(a, b, 1024):
            mine = column[at : min(b, at + 1024)].to_pylist()
            out[at : at + len(mine)] = one.many([grams(x) if x is not None else () for x in mine])
    return out


def as_lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def hash_embedding(words: Column, dim: int = 768) -> Column:
    """array<double>: signed counts of hashed grams at length one.

    A gram's blake2b of eight bytes, big-endian, gives its place modulo `dim`, and bit 33, counted from 0, the sign.
    """
    return _embedded(words, list, dim)


def text_embedding(raw: Column, dim: int = 768) -> Column:
    """hash_embedding of the runs of one and two words of a text, which are made where they are hashed."""
    return _embedded(raw, text.grams_of, dim)


def _embedded(values: Column, grams: Callable, dim: int) -> Column:
    one = gram_hasher(dim)

    @F.arrow_udf("array<double>")
    def embed(column: pa.Array) -> pa.Array:
        return as_lists(vectors_of(column, grams, one, dim))

    return embed(values)


def extractive_answer(chunks: DataFrame, question: str, k: int = 3, least_words: int = 4, dim: int = 256, id_col: str = "chunk_id", body: str = "text") -> DataFrame:
    """One row: the k distinct sentences most like the question, joined, how many there are, and abstained if none.

    Sentences under `least_words` words do not count. Likeness is the cosine of hashed embeddings. A task passes on the best k
    of its sentences, each once with its first place: a sentence among the best of all is among the best of where its first place is.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.posexplode(text.sentences(F.col(body))).alias("at", "sentence"))
    rows = rows.where(F.size(F.split("sentence", r"\s+")) >= least_words)
    one = gram_hasher(dim)
    asked = one(text.grams_of(question))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            sentences = batch.column("sentence")
            likeness = np.round(np.concatenate([one.many([text.grams_of(s) for s in sentences[a : a + 1024].to_pylist()]) @ asked for a in range(0, len(sentences), 1024)] or [np.zeros(0)]), 9)
            worst = min((-x[0] for x in known.values()), default=-2.0) if len(known) == k else -2.0
            able = np.flatnonzero(likeness >= worst)
            ids, places = (batch.column(c).take(pa.array(able)).to_pylist() for c in ("id", "at"))
            for i, id_, at in zip(able.tolist(), ids, places):
                if len(known) == k and likeness[i] < worst:
                    continue
                sentence, place = sentences[i].as_py(), (-float(likeness[i]), id_ is not None, id_ if id_ is not None else 0, at)
                if sentence not in known or place < known[sentence]:
                    known[sentence] = place
                    if len(known) > k:
                        del known[max(known, key=known.get)]
                    worst = -max(known.values())[0] if len(known) == k else -2.0
        if kind is not None:
            of = list(known.values())
            yield pa.RecordBatch.from_arrays([pa.array([x[2] if x[1] else None for x in of], kind), pa.array([x[3] for x in of], pa.int32()), pa.array(list(known), pa.string()), pa.array([-x[0] for x in of], pa.float64())], ["id", "at", "sentence", "likeness"])

    schema = T.StructType([*rows.schema.fields, T.StructField("likeness", T.DoubleType())])
    first = rows.mapInArrow(best, schema).groupBy("sentence").agg(F.min(F.struct("id", "at")).alias("place"), F.first("likeness").alias("likeness"))
    best_of_all = first.orderBy(F.desc("likeness"), "place").limit(k)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("likeness")).alias("l"), "place", "sentence"))), lambda x: x["sentence"]), " ")
    return best_of_all.agg(joined.alias("answer"), F.count(F.lit(1)).alias("sentences"), (F.count(F.lit(1)) == 0).alias("abstained"))
