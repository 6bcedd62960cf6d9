"""Speeches made searchable, and questions answered from what they say.

A store is a Parquet table with a row for each chunk of a speech and its vector. An embedder is an expression:
array<string> of texts -> array<array<float>>, one vector for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stancelake import errors, session
from stancelake.functions import text
from stancelake.operators import blocks, ingest, retrieval

#: Ids that are sent to all tasks at most; more are joined.
FEW = 1 << 16

Embedder = Callable[[Column], Column]

#: What a store has of each chunk; all else about a speech stays in the table of speeches.
STORE = "speech_id, chunk_index, text, embedding"

# What is said before an answer and instead of one.
PREFIX = "No language model is configured (offline mode), so this is an extractive answer drawn from the most relevant retrieved passages:"
NOTHING_OF_SPEAKER = "I could not find anything in this speaker's speeches that addresses that question."
NOTHING_OF_ANY = "I could not find anything in the speeches I have analyzed that addresses that question."


def hash_embedder(dim: int = 768, digest: str = "blake2b") -> Embedder:
    """Vectors of retrieval.hash_embedding over one and two words, as float; `digest` is one of retrieval.DIGESTS."""

    one = retrieval.gram_hasher(dim, digest)

    @F.arrow_udf("array<array<float>>")
    def embed(texts: pa.Array) -> pa.Array:
        rows = retrieval.as_lists(retrieval.vectors_of(texts.flatten(), text.grams_of, one, dim, np.float32))
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), rows, mask=pc.is_null(texts))

    return embed


def chunk_rows(speeches: DataFrame, embed: Embedder, most: int = 1000, overlap: int = 100, id_col: str = "speech_id", body: str = "text") -> DataFrame:
    """speech_id, chunk_index, text, embedding of all chunks; fails on a speech whose vectors are not one for each chunk.

    Speeches without words have no chunks.
    """
    packed = speeches.select(F.col(id_col).alias("speech_id"), text.chunk(F.col(body), most, overlap).alias("chunks"))
    made = packed.where(F.size("chunks") > 0).withColumn("vectors", embed(F.col("chunks")))
    n, m = F.size("chunks"), F.coalesce(F.size("vectors"), F.lit(-1))
    checked = F.when(n == m, F.arrays_zip("chunks", "vectors")).otherwise(F.raise_error(F.format_string(f"{errors.ScorerFailed.__name__}: %d vectors for %d chunks", m, n)))
    rows = made.select("speech_id", F.posexplode(checked).alias("chunk_index", "c"))
    return rows.select("speech_id", "chunk_index", F.col("c.chunks").alias("text"), F.col("c.vectors").cast("array<float>").alias("embedding"))


def open_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at `path`, None before its first chunk."""
    return spark.read.parquet(path) if session.holds_rows(spark, path) else None


def index_speeches(speeches: DataFrame, path: str, embed: Embedder, most: int = 1000, overlap: int = 100, id_col: str = "speech_id", body: str = "text") -> int:
    """Adds the chunks of speeches that the store has none of yet; the number of chunks added.

    A speech is indexed once: run again, or in two batches that overlap, it adds nothing. One writer at a time.
    """
    stored = open_store(speeches.sparkSession, path)
    if stored is not None:
        # which are new is found by their ids; texts of others are neither shuffled nor joined
        fresh = session.checkpointed(ingest.unseen(speeches.select(id_col).distinct(), stored.select(F.col("speech_id").alias(id_col)).distinct(), [id_col]))
        few = fresh.count() <= FEW
        named = fresh.withColumnRenamed(id_col, "fresh_")
        speeches = speeches.join(F.broadcast(named) if few else named, F.col(id_col).eqNullSafe(F.col("fresh_")), "left_semi")
    rows = speeches.dropDuplicates([id_col])
    seen = Observation(f"chunks-{uuid.uuid4().hex}")
    ingest.append(chunk_rows(rows, embed, most, overlap, id_col, body).observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def index_speech(speeches: DataFrame, speech_id: object, path: str, embed: Embedder, id_col: str = "speech_id", **how) -> int:
    """index_speeches of one speech; an unknown one is an error."""
    mine = speeches.where(F.col(id_col) == F.lit(speech_id))
    if mine.isEmpty():
        raise errors.EntityNotFound("Speech", speech_id)
    return index_speeches(mine, path, embed, id_col=id_col, **how)


def chunks_of_speeches(store: DataFrame, speeches: DataFrame, *fields: str, only: Column | None = None) -> DataFrame:
    """Chunks with fields of their speech; `only` filters speeches before the join, so that chunks of others are not read on."""
    wanted = speeches if only is None else speeches.where(only)
    return store.join(wanted.select("speech_id", *fields), "speech_id")


def chunk_counts(store: DataFrame) -> DataFrame:
    """speech_id, chunks."""
    return store.groupBy("speech_id").agg(F.count(F.lit(1)).alias("chunks"))


def question_vector(spark: SparkSession, question: str, embed: Embedder) -> list[float]:
    vectors = spark.range(1).select(embed(F.array(F.lit(question))).alias("v")).first()["v"]
    if not vectors or len(vectors) != 1:
        raise errors.ScorerFailed(f"{len(vectors or ())} vectors for one question")
    return [float(x) for x in vectors[0]]


def search(store: DataFrame, speeches: DataFrame, vector: list[float], k: int = 5, speaker: object = None) -> DataFrame:
    """speech_id, chunk_index, text, title, url, distance of the k nearest chunks, of one speaker if named; ties by id and index."""
    only = None if speaker is None else F.col("speaker_id") == F.lit(speaker)
    distance = retrieval.cosine_distance(F.col("embedding"), F.lit(vector))
    # distances before the join, which then shuffles no vectors
    near = store.select("speech_id", "chunk_index", "text", distance.alias("distance"))
    found = chunks_of_speeches(near, speeches, "title", "url", only=only).orderBy(F.round("distance", 12), "speech_id", "chunk_index").limit(k)
    return found.select("speech_id", "chunk_index", "text", "title", "url", "distance")


def citations(found: DataFrame) -> DataFrame:
    """What is cited of a chunk: speech_id, chunk_index, title, url."""
    return found.select("speech_id", "chunk_index", "title", "url")


def answer_of(found: DataFrame, question: str, embed: Embedder, nothing: str, most: int = 3, least_words: int = 4) -> DataFrame:
    """One row: answer, citations, abstained, from the chunks found. Those are few, and gathered in one row.

    The answer is the sentences most like the question, each once, with the titles they come from; if no sentence
    has `least_words` words it is the first chunk. Nothing found is an abstention.
    """
    place = F.struct(F.round("distance", 12).alias("d"), "speech_id", "chunk_index")
    chunks = F.sort_array(F.collect_list(F.struct(place.alias("place"), "text", "title", "url")))
    one = found.agg(chunks.alias("chunks"))
    sents = F.flatten(F.transform("chunks", lambda c: F.transform(text.sentences(c["text"]), lambda s: F.struct(s.alias("sentence"), c["title"].alias("title")))))
    one = one.withColumn("sents", F.filter(sents, lambda s: F.size(F.split(s["sentence"], r"(?U)\s+")) >= least_words))
    vectors = embed(F.concat(F.array(F.lit(question)), F.transform("sents", lambda s: s["sentence"])))
    one = one.withColumn("vectors", vectors)
    asked = F.transform(F.element_at("vectors", 1), lambda x: x.cast("double"))
    likeness = F.transform(F.slice("vectors", 2, F.greatest(F.size("vectors"), F.lit(1))), lambda v: F.round(retrieval.dot(v, asked), 9))
    ranked = F.array_sort(F.transform(F.arrays_zip(F.col("sents"), likeness.alias("like")), lambda x, i: F.struct((-x["like"]).alias("l"), i.alias("at"), x["sents"]["sentence"].alias("sentence"), x["sents"]["title"].alias("title"))))
    one = one.withColumn("ranked", ranked)
    first = F.filter("ranked", lambda x, i: ~F.exists(F.slice(F.col("ranked"), F.lit(1), i), lambda y: y["sentence"] == x["sentence"]))
    lines = F.transform(F.slice(first, 1, most), lambda x: F.concat(F.lit("- "), x["sentence"], F.lit(" ("), x["title"], F.lit(")")))
    whole = F.transform(F.slice("chunks", 1, 1), lambda c: F.concat(F.lit("- "), F.regexp_replace(c["text"], text.EDGES, ""), F.lit(" ("), c["title"], F.lit(")")))
    shown = F.concat(F.lit(PREFIX + "\n\n"), F.array_join(F.when(F.size("ranked") > 0, lines).otherwise(whole), "\n"))
    none = F.size("chunks") == 0
    cited = F.transform("chunks", lambda c: F.struct(c["place"]["speech_id"].alias("speech_id"), c["place"]["chunk_index"].alias("chunk_index"), c["title"].alias("title"), c["url"].alias("url")))
    return one.select(F.when(none, nothing).otherwise(shown).alias("answer"), cited.alias("citations"), none.alias("abstained"))


def ask_speaker(store: DataFrame, speeches: DataFrame, speakers: DataFrame, speaker: object, question: str, embed: Embedder, k: int = 5, most_distance: float = 0.6) -> DataFrame:
    """answer_of the speaker's chunks within the distance; an unknown speaker is an error. The threshold comes after the k."""
    if speakers.where(F.col("speaker_id") == F.lit(speaker)).isEmpty():
        raise errors.EntityNotFound("Speaker", speaker)
    found = search(store, speeches, question_vector(store.sparkSession, question, embed), k, speaker)
    return answer_of(found.where(F.col("distance") <= most_distance), question, embed, NOTHING_OF_SPEAKER)


def ask_corpus(store: DataFrame, speeches: DataFrame, question: str, embed: Embedder, k: int = 5, most_distance: float = 0.6) -> DataFrame:
    """answer_of the chunks of all speakers within the distance."""
    found = search(store, speeches, question_vector(store.sparkSession, question, embed), k)
    return answer_of(found.where(F.col("distance") <= most_distance), question, embed, NOTHING_OF_ANY)


# -- approximate search --------------------------------------------------------------------------------------


def centroids(rows: DataFrame, n: int = 64, most: int = 20_000, rounds: int = 12, seed: int = 3, vector: str = "embedding") -> np.ndarray:
    """(n, dim) unit centres of a spherical k-means over at most `most` vectors, the documented bound of what is fitted.

    Those are the vectors with the least hashes. Every row is indexed by the result, whatever it was fitted to.
    """
    place = F.xxhash64(F.lit(seed), vector)
    total = rows.count()
    bound = min(2**63 - 1, -(2**63) + (most + most // 8 + 64) * 2**64 // max(1, total))
    sample = rows.where(F.col(vector).isNotNull()).where(place <= F.lit(bound)).select(vector, place.alias("p")).dropDuplicates(["p"]).orderBy("p").limit(most)
    x = np.array([r[vector] for r in sample.select(vector).collect()], float)
    if not len(x):
        raise errors.InsufficientData("no vectors to fit an index to")
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = x[np.random.default_rng(seed).permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(rounds):
        of = np.argmax(x @ out.T, axis=1)
        for k in range(len(out)):
            if (of == k).any():
                out[k] = x[of == k].sum(axis=0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
    return out


def lists_of(vector: Column, centres: np.ndarray, probes: int = 1) -> Column:
    """array<int>: the nearest centres of a vector; the first is the list that it is in."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        likeness = np.stack(vectors.to_numpy()).astype(float) @ centres.T if len(vectors) else np.zeros((0, len(centres)))
        return pd.Series(list(np.argsort(-likeness, axis=1, kind="stable")[:, :probes].astype(np.int32)), dtype=object)

    return nearest(vector)


def nearest_by_lists(rows: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 8, parts: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, id, distance, rank: of each query the k nearest rows in the `probes` lists nearest to it.

    Every row is in one list. Lists are dealt to cells, at least about `parts` in all, so that a hot one is not one task; see
    blocks.in_lists.
    """
    named = lambda x: x.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    indexed = named(rows).select("id", "v", lists_of(F.col("v"), centres)[0].alias("list"))
    asked = named(queries).select("id", "v", F.explode(lists_of(F.col("v"), centres, probes)).alias("list"))
    return blocks.in_lists(indexed, asked, k, max(parts, 2 * rows.sparkSession.sparkContext.defaultParallelism)).select("query", "id", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query, id) that were found."""
    total = exact.count()
    return found.select("query", "id").join(exact.select("query", "id"), ["query", "id"]).count() / total if total else 1.0
