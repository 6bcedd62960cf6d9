"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Texts are normalised to lower-case words. Every window of `width` consecutive words of a benchmark text, or the
whole of a shorter one, is a pattern. Words are spelt in the automaton by their numbers in the benchmark's
vocabulary, two letters each (three for vocabularies over 65,536), which keeps both its nodes and their branches
few; a word that the benchmark has not ends every match, so only runs of known words are read. The automaton
reads each document once and gives the end of every occurrence; word numbers map to byte offsets of the
original text, so hits are reported as spans of the original.

The bound is on the automaton: a benchmark whose windows need over `most_nodes` nodes (about 60 bytes each) is dealt
to parts by windows. Each part is a scan of its own, in tasks that hold one automaton, and gives rows only for
documents with hits, which are then merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm import text

#: Words in a window, most nodes of an automaton, and windows of one benchmark text that stay together.
WIDTH, MOST_NODES, TOGETHER = 10, 4_000_000, 4096


def words_of(raw: bytes) -> list[bytes]:
    data = text.lower_ascii(np.frombuffer(raw, np.uint8))
    starts, ends, _ = text.word_spans(data, np.array([0, len(data)]), text.ALNUM)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts, ends)]


def word_hash(word: bytes) -> int:
    return int(text.SpanHash(np.frombuffer(word, np.uint8)).of(np.array([0]), np.array([len(word)]))[0])


class Machine:
    """An automaton over windows: pattern -> (number of its words, the items that have it; those without id are none)."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH) -> None:
        texts = [(item, words_of(raw.encode())) for item, raw in items]
        known = {word: word_hash(word) for _, words in texts for word in words}
        self.hashes = np.array(sorted(set(known.values())), np.uint64)
        self.letters = 2 if len(self.hashes) <= 1 << 16 else 3
        self.base = max(2, int(np.ceil(len(self.hashes) ** (1 / self.letters))) + 1)
        found: dict[str, tuple[int, set[str]]] = {}
        for item, words in texts:
            size = min(width, len(words))
            spelt = self.spelt(np.searchsorted(self.hashes, np.array([known[w] for w in words], np.uint64)))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(spelt[i * self.letters : (i + size) * self.letters], (size, set()))[1].update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton()
        for pattern, (size, having) in found.items():
            self.automaton.add_word(pattern, (size, tuple(sorted(having))))
        self.automaton.make_automaton()
        self.least = min((size for size, _ in found.values()), default=0)

    def spelt(self, numbers: np.ndarray) -> str:
        """Letters of each place have an alphabet of their own, so that matches begin and end at words."""
        out = np.empty((len(numbers), self.letters), np.uint32)
        for k in range(self.letters):
            out[:, k] = numbers // self.base ** (self.letters - 1 - k) % self.base + k * self.base
        out += (out >= 0xD000) * np.uint32(0x2000)  # no surrogates
        return out.astype("<u4").tobytes().decode("utf-32-le")

    def matches(self, hashes: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(last word, number of words, items) of every occurrence in words with these hashes and rows."""
        if not self.least or not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        breaks = np.flatnonzero(np.diff(known, prepend=False, append=False) | (np.diff(of, prepend=of[0], append=of[-1]) != 0))
        edges = np.unique(np.concatenate([[0], breaks, [len(hashes)]]))
        long = (np.diff(edges) >= self.least) & known[edges[:-1]]
        for a, b in zip(edges[:-1][long].tolist(), edges[1:][long].tolist()):
            for end, (size, items) in self.automaton.iter(self.spelt(at[a:b])):
                yield a + end // self.letters, size, items


SPANS = "array<struct<first:bigint,words:bigint,begin:bigint,end:bigint>>"

_SPAN_TYPE = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "words", "begin", "end")]))

_KEPT: dict[str, Machine] = {}


def _machine(name: str, items: list[tuple[str | None, str]], width: int) -> Machine:
    """That of the last scan stays in the worker, so that its next tasks need not build it again."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Machine(items, width)
    return _KEPT[name]


def _scan(machine: Machine, part: pa.RecordBatch) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Numbers of words, spans and items of each row."""
    data, offsets = text.joined(part.column("text"))
    low = text.lower_ascii(data)
    starts, ends, of = text.word_spans(low, offsets, text.ALNUM)
    first_word = np.searchsorted(of, np.arange(part.num_rows + 1))
    spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    marks = None
    for last, size, having in machine.matches(text.SpanHash(low).of(starts, ends), of):
        marks = np.zeros(len(starts) + 1, np.int64) if marks is None else marks
        marks[last - size + 1] += 1
        marks[last + 1] -= 1
        items[of[last]].update(having)
    if marks is not None:
        hit = np.cumsum(marks[:-1]) > 0
        first = hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], of[1:] == of[:-1]]))
        begins = np.flatnonzero(first)
        sizes = np.add.reduceat(hit.astype(np.int64), begins)
        for a, size in zip(begins.tolist(), sizes.tolist()):
            row = int(of[a])
            spans[row].append({"first": a - int(first_word[row]), "words": size, "begin": int(starts[a] - offsets[row]), "end": int(ends[a + size - 1] - offsets[row])})
    return np.diff(first_word), spans, [sorted(x) for x in items]


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """(item, text, nodes): texts of over TOGETHER windows are cut so that each window is in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(raw.encode())
                windows = max(1, len(words) - width + 1)
                cuts = [words[at : at + TOGETHER + width - 1] for at in range(0, windows, TOGETHER)] if words else []
                for cut in cuts:
                    size = min(width, len(cut)) * max(1, len(cut) - width + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(cut)]).cast(pa.string()), pa.array([2 * size], pa.int64())], ["item", "text", "nodes"])

    return items.mapInArrow(run, "item string, text string, nodes bigint")


def scan(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, most_nodes: int = MOST_NODES, carry: bool = False) -> DataFrame:
    """One row per row of `documents`: id, n_words, spans, items. No shuffle while one automaton holds the benchmark.

    `carry` adds a struct column `row` with all columns of `documents`, whatever their names.

    spans: number of the first word and number of words, begin and end (bytes of the original UTF-8, end exclusive) of
    each maximal run of hit words, in order. items: ids, as strings in string order, of the benchmark rows with an
    occurring window. Null or empty texts have no words; benchmark rows without words match nothing; those without
    id mark words like all others, but are not in items. Repeated rows are alike; an empty table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    pieces = _pieces(items, width)
    parts = pieces.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0] // most_nodes + 1
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    if parts == 1:
        return _scanned(rows, pieces, width).withColumnRenamed("id", id_col)
    # equal texts have equal hits, so a text's hash stands for it
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    short = rows.select("text").withColumn("id", key)
    each = [_scanned(short, pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k), width, hits_only=True) for k in range(parts)]
    hits = each[0]
    for more in each[1:]:
        hits = hits.unionByName(more)
    hits = hits.dropDuplicates(["id", "part"]).groupBy("id").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")
    rows = rows.withColumn("key", key).withColumn("n_words", n_words)
    out = rows.join(hits.withColumnRenamed("id", "key"), "key", "left")
    none = F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")), F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(F.col("id").alias(id_col), "n_words", none[0].alias("spans"), none[1].alias("items"), *(["row"] if carry else []))


def _merged(spans: Column) -> Column:
    """Runs of words that overlap or touch as one."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        until = last["first"] + last["words"]
        longer = F.struct(last["first"].alias("first"), (F.greatest(until, span["first"] + span["words"]) - last["first"]).alias("words"), last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        apart = (F.size(done) == 0) | (span["first"] > F.try_element_at(done, F.lit(-1))["first"] + F.try_element_at(done, F.lit(-1))["words"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {SPANS})"), add)


def _scanned(rows: DataFrame, pieces: DataFrame, width: int, hits_only: bool = False) -> DataFrame:
    """n_words, spans and items beside the columns of `rows` but text; `hits_only`: of rows with hits, with the scan's name."""
    shared = rows.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in pieces.select("item", "text").collect()])  # bounded by most_nodes
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared.value, width)
        for batch in batches:
            for part in text.steps(batch, "text"):
                n_words, spans, items = _scan(machine, part)
                new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPAN_TYPE), "items": pa.array(items, pa.list_(pa.string()))}
                if hits_only:
                    kept = pa.array([bool(x) for x in spans], pa.bool_())
                    columns = {"id": part.column("id"), "spans": new["spans"], "items": new["items"], "part": pa.array([name] * part.num_rows)}
                    yield pa.RecordBatch.from_pydict(columns).filter(kept)
                else:
                    columns = {c: part.column(c) for c in part.schema.names if c != "text"} | new
                    yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    if hits_only:
        return rows.mapInArrow(run, f"id string, spans {SPANS}, items array<string>, part string")
    order = ["id", "n_words", "spans", "items", *(["row"] if "row" in rows.columns else [])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"n_words": "bigint", "spans": SPANS, "items": "array<string>"}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in order))
