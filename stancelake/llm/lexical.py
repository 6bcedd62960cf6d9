"""Ranked lexical search over document-sharded postings.

A shard holds some consecutive documents of a task: its distinct terms, and for each term the numbers of the documents
that hold it and the integer impact of each, one array for all terms with offsets between them. Impacts need two numbers
of the whole table, so one pass counts and the next makes the shards; no text is shuffled. A shard is a row of a
Parquet table, which any number of searches read.

A search scores a query item's terms one by one into a dense array over a shard's documents and takes the best; a task
keeps the best of all shards it has read, and Spark merges those of the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancelake.llm import text

#: Bytes of text in a shard, where a longer text is a shard of its own, and documents at most.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16

#: Bytes of query text that tasks are sent at once; more are searched in blocks.
BLOCK_BYTES = 8 << 20

SHARD = "ids binary, unknown binary, lengths binary, terms binary, ends binary, starts binary, docs binary, impacts binary"


def tokens(column: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of a text column in order, and the row of each: runs of digits, letters A-Z lower-cased, and non-ASCII characters."""
    data, offsets = text.joined(column)
    low = text.lower_ascii(data)
    starts, ends, of = text.word_spans(low, offsets, text.ALNUM)
    whole = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=whole[1:])
    packed = low[text.ALNUM[low]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(whole.tobytes()), pa.py_buffer(packed.tobytes())), of


def statistics(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and the terms of all documents with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = total = 0
        for batch in batches:
            for part in text.steps(batch, "text"):
                data, offsets = text.joined(part.column("text"))
                starts, _, of = text.word_spans(text.lower_ascii(data), offsets, text.ALNUM)
                holding += len(np.unique(of))
                total += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([holding], pa.int64()), pa.array([total], pa.int64())], ["holding", "total"])

    counts = documents.select(F.col(text_col).alias("text")).mapInArrow(run, "holding bigint, total bigint")
    row = counts.agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return row[0], row[1]


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int, b: int = 75, k: int = 8) -> np.ndarray:
    """(10^9 tf) div (1000 tf + k m), m = 100 - b + (b n documents) div total, of each posting; n: its document's terms."""
    sizes, of = np.unique(n, return_inverse=True)
    m = np.array([100 - b + (b * int(x) * documents) // total for x in sizes.tolist()], np.int64)[of] if len(sizes) else np.zeros(0, np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + k * m)


def _shard(ids: pa.Array, texts: pa.Array, documents: int, total: int) -> pa.RecordBatch:
    words, of = tokens(texts)
    n = np.bincount(of, minlength=len(ids)).astype(np.int64)
    coded = words.dictionary_encode()
    terms = coded.dictionary
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + of, return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    impacts = impact(tf.astype(np.int64), n[doc], documents, total)
    flat, offsets = text.joined(terms)
    arrays = (
        pc.fill_null(ids, 0).to_numpy().astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False), n, flat, offsets[1:], starts.astype(np.int64), doc.astype(np.uint16), impacts.astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], [f.split()[0] for f in SHARD.split(", ")])


def build(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes the shards of all `documents` to `path` and returns them.

    Every row is a document of its own, also where ids are null or repeat; ids are whole numbers. Null and empty texts,
    and texts without terms, have no postings and count neither among the documents nor in their lengths. A very long text
    is a shard of its own. An empty table gives no shards.
    """
    spark = documents.sparkSession
    holding, total = statistics(documents, text_col)
    most = min(shard_docs, SHARD_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = rows = 0

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting)
            return _shard(whole.column("id").combine_chunks(), whole.column("text").combine_chunks(), holding, total)

        for batch in batches:
            for part in text.steps(batch, "text", min(text.STEP_BYTES, shard_bytes)):
                for at in range(0, part.num_rows, most):
                    cut = part.slice(at, most)
                    size = int(pc.sum(pc.binary_length(cut.column("text"))).as_py() or 0)
                    if waiting and (held + size > shard_bytes or rows + cut.num_rows > most):
                        yield shard()
                        waiting, held, rows = [], 0, 0
                    waiting.append(cut)
                    held, rows = held + size, rows + cut.num_rows
        if waiting:
            yield shard()

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    rows.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


class _Shard:
    """The arrays of one row of the index; only what is asked for is read."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.of = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)
        ends = self.of("ends", np.int64)
        offsets = np.concatenate([[0], ends])
        self.terms = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(batch.column("terms")[row].as_py()))
        self.starts = self.of("starts", np.int64)

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Number of each wanted term in this shard, -1 where it has none."""
        return pc.fill_null(pc.index_in(wanted, value_set=self.terms), -1).to_numpy().astype(np.int64)


def frequencies(index: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Documents of the whole index that hold each wanted term; terms that none holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(wanted, pa.large_string())
        count = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Shard(batch, row)
                at = shard.places(asked)
                count += np.where(at >= 0, np.diff(np.append(shard.starts, shard.starts[-1]))[at], 0)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there], pa.int64())], ["term", "df"])

    found = index.select("terms", "ends", "starts").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted[r["term"]]: r["df"] for r in found.collect()}  # at most one row for each wanted term


def best(scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, best first; equal scores by ascending id, unknown ids last.

    The k-th score is found by partition; all places that reach it are then ordered, so that no tie is cut by chance.
    """
    if len(scores) > k:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]))
        places = np.flatnonzero(scores >= least)
    else:
        places = np.flatnonzero(scores > 0)
    return places[np.lexsort((ids[places], unknown[places], -scores[places]))[:k]]


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of each query row with a score above 0.

    score: sum over the item's terms, repeats included, of floor(1000 ln((2 N + 2) / (2 df + 1))) * impact. Equal scores
    rank by ascending id, null ids last; repeated rows of documents are documents of their own. Items with a null or empty
    text or terms that no document holds have no rows. Items that share an id are searched one by one, and so have
    ranks of their own. Queries go to tasks in blocks of `block_bytes` of text, a longer item alone.
    """
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where(F.octet_length("text") > 0)
    name = text.free_name(["rank", "doc_id", "score"], item_col)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // block_bytes + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    holding = index.select("lengths").mapInArrow(_holding, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [_searched(index, asked.where(block == p).select("item", "text").collect() if parts > 1 else asked.collect(), holding, k, asked) for p in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("item", name)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = sum(int((np.frombuffer(x.as_py(), np.int64) > 0).sum()) for batch in batches for x in batch.column("lengths"))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _searched(index: DataFrame, items: list, holding: int, k: int, asked: DataFrame) -> DataFrame:
    spark = index.sparkSession
    words, of = tokens(pa.array([r["text"] for r in items], pa.string()))
    coded = words.dictionary_encode()
    wanted, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    df = frequencies(index, wanted) if wanted else {}
    weight = [math.floor(1000 * math.log((2 * holding + 2) / (2 * df[t] + 1))) if t in df else 0 for t in wanted]
    pairs, repeats = np.unique(of * max(1, len(wanted)) + numbers, return_counts=True)
    item_of, term_of = np.divmod(pairs, max(1, len(wanted)))
    factor = np.array(weight, np.int64)[term_of] * repeats if len(pairs) else np.zeros(0, np.int64)
    bounds = np.searchsorted(item_of, np.arange(len(items) + 1))
    sent = spark.sparkContext.broadcast((wanted, term_of, factor, bounds))  # bounded by a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, term_of, factor, bounds = sent.value
        terms = pa.array(wanted, pa.large_string())
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * (len(bounds) - 1)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Shard(batch, row)
                at = shard.places(terms)
                ids, unknown, docs, impacts = shard.of("ids", np.int64), shard.of("unknown", bool), shard.of("docs", np.uint16), shard.of("impacts", np.int32)
                scores = np.zeros(len(ids), np.int64)
                for item in range(len(bounds) - 1):
                    scores[:] = 0
                    for j in range(bounds[item], bounds[item + 1]):
                        t = at[term_of[j]]
                        if t >= 0 and factor[j]:
                            a, b = shard.starts[t], shard.starts[t + 1]
                            scores[docs[a:b]] += factor[j] * impacts[a:b].astype(np.int64)
                    top = best(scores, ids, unknown, k)
                    if len(top):
                        both = [np.concatenate([x, y]) for x, y in zip(kept[item], (scores[top], ids[top], unknown[top]))]
                        order = np.lexsort((both[1], both[2], -both[0]))[:k]
                        kept[item] = tuple(x[order] for x in both)
        of = np.repeat(np.arange(len(kept)), [len(x[0]) for x in kept])
        joined = [np.concatenate([x[c] for x in kept]) if kept else np.zeros(0, np.int64) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(joined[1], pa.int64(), mask=joined[2].astype(bool)), pa.array(joined[0], pa.int64())], ["number", "doc_id", "score"])

    tops = index.select("ids", "unknown", "terms", "ends", "starts", "docs", "impacts").mapInArrow(run, "number int, doc_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(items)], f"number int, item {asked.schema['item'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "number").select("item", "rank", "doc_id", "score")  # names: a block of queries
