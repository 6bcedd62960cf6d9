"""Language model by online logistic mixing of hashed-context bit predictors (after Mahoney's PAQ).

A text is a run of tokens: its lower-cased words, each written with a space behind it, and a line feed as end.
It is coded in two layers of binary decisions.

Passages. Words whose hash says so end a segment, eight words long in the mean, as does the end of a text. The
context of a segment is the whole segment before it. If the corpus has that context, one decision says whether
the segment is one that stood behind it there; if it is, a share of the context's count says which. Its
probability is refined over all training passages by how often the context was seen. A text is never
predicted from itself: all of a training text's own counts are taken out. Texts that do not train have no part in it.

Letters. All other segments are spelt. A byte is a few decisions on its path in a Huffman tree over the corpus'
bytes. Contexts of a decision are the last two, four and six bytes, which reach to the class of the word before,
and the whole word so far without and with that class; hashed with the node of the tree, each names a slot that
counts the zeros and ones the corpus had there. The log-odds of the slots are combined by the weights of a gate,
chosen by how often the longest known contexts were seen, and their logistic is the probability of the decision.
Weights are refined adaptively by online gradient steps over the whole training corpus, with each occurrence's
own counts taken out. Spelling depends on the token and that class, so each distinct pair is counted, learnt from
and scored once, with its multiplicity, and texts get sums of what their pairs have.

How it is dealt out: the rows of a task are read in blocks, bounded in tokens. A block's distinct pairs go to
buckets by the hash of the word, its hashes of segments and their contexts to other buckets by hash, and the
answers go back to the block, in its own order. Buckets are sized by what is distinct, which is counted before.
So nothing is sampled, the lexicon is never in one place, no key has more than one row of each block, and what is
gathered grows with the corpus. Only the tables of slots, sized by the lexicon up to MOST_SLOTS, are broadcast.
Pairs and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm import graph, text

#: Tokens of a block; bytes of distinct words and number of distinct hashes in a bucket; evidence added to both counts; step size; entries in a step.
BLOCK_TOKENS, BUCKET_BYTES, BUCKET_KEYS, PRIOR, RATE, STEP = 2 << 20, 4 << 20, 2 << 20, 0.35, 1.0, 512

#: Numbers of last bytes that are contexts; the word so far, without and with the class, are two more.
ORDERS = (2, 4, 6)

#: Slots of each context for a byte of distinct words, and the bounds of a table.
SLOTS_PER_BYTE, LEAST_SLOTS, MOST_SLOTS = (1 / 256, 1 / 32, 1 / 16, 1 / 4, 1 / 4), 1 << 14, 1 << 23

CONTEXTS = len(SLOTS_PER_BYTE)

#: Edges of how often the word so far was seen, and gates: those classes by the longest known context.
SEEN = np.array([1, 2, 4, 8, 32, 256])
GATES = (len(SEEN) + 1) * 3

END, SPACE, START_CLASS = 10, 32, 0

#: One word in so many ends a segment; classes of how often its context was seen, by doubling.
SEGMENT_WORDS, SEGMENT_CLASSES = 8, 64

#: Tokens that are summed at once, of whole rows.
SUMMED_TOKENS = 1 << 18

#: One distinct pair in so many is counted to size the buckets.
SAMPLED = 64

_CHUNK = 1 << 14


# -- tokens of rows ------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """All tokens of some rows: spans in `data` (ends have an empty span), class, row, hash of the word and of the pair."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    classes: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    pairs: np.ndarray


#: The class of a word by its last byte: a-z are one, digits another, and each other byte is its own.
CLASS_OF = np.arange(256, dtype=np.uint8)
CLASS_OF[97:123] = ord("a")
CLASS_OF[48:58] = ord("0")

_END_HASH = np.uint64(0x1F0D3C5A7E6B9824)


def pair_of(words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A hash with the upper half of the word's own on top, so that pairs in order are in the order of buckets."""
    low = text.mixed(words * np.uint64(0xD6E8FEB86659FD93) + text.mixed(classes.astype(np.uint64) + np.uint64(1 << 40)))
    return words >> _HALF << _HALF | low >> _HALF


_HALF = np.uint64(32)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, all of about the same size."""
    return ((hashes >> _HALF) * np.uint64(buckets) >> _HALF).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words of each row in order, then its end; the class is that of the word before, 0 for none."""
    low, n = text.lower_ascii(data), len(offsets) - 1
    starts, ends, rows = text.word_spans(low, offsets, text.NOT_SPACE)
    words = text.SpanHash(low).of(starts, ends)
    place = np.arange(len(starts)) + rows  # an end stands behind each row's words
    finish = np.searchsorted(rows, np.arange(n), "right") + np.arange(n)
    total = len(starts) + n
    out = Tokens(low, *(np.zeros(total, t) for t in (np.int64, np.int64, np.uint8, np.int64, np.uint64)), np.zeros(0, np.uint64))
    out.starts[place], out.ends[place], out.rows[place], out.words[place] = starts, ends, rows, words
    out.rows[finish], out.words[finish] = np.arange(n), _END_HASH
    last = np.zeros(total, np.uint8)
    last[place] = CLASS_OF[low[ends - 1]] if len(starts) else 0
    out.classes[1:] = last[:-1] * (out.rows[1:] == out.rows[:-1])
    out.pairs = pair_of(out.words, out.classes)
    return out


# -- the lexicon as columns of bytes -------------------------------------------------------------------------


_ZSTD = pa.Codec("zstd")


def squeezed(values: np.ndarray) -> bytes:
    """The bytes of an array, those of one significance together, compressed, behind their number."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return values.nbytes.to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def restored(packed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little")), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


@dataclass
class Entries:
    """Distinct pairs: bytes of the words one after the other (an end has none), lengths, classes, training counts."""

    blob: np.ndarray
    lengths: np.ndarray
    classes: np.ndarray
    counts: np.ndarray

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.lengths.astype(np.int64))
        starts, words, at = ends - self.lengths, np.zeros(len(ends), np.uint64), 0
        while at < len(ends):  # about STEP_BYTES of words at a time
            base = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, base + text.STEP_BYTES, "right")))
            words[at:stop] = text.SpanHash(self.blob[base : ends[stop - 1]]).of(starts[at:stop] - base, ends[at:stop] - base)
            at = stop
        words[self.lengths == 0] = _END_HASH
        return words, pair_of(words, self.classes)

    def take(self, index: np.ndarray) -> Entries:
        starts = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        return Entries(gather(self.blob, starts[index], self.lengths[index].astype(np.int64)), self.lengths[index], self.classes[index], self.counts[index])

    def pack(self) -> list[bytes]:
        return [squeezed(self.blob), squeezed(self.lengths.astype(np.uint32)), squeezed(self.classes), squeezed(self.counts.astype(np.uint64))]

    TYPES = (np.uint8, np.uint32, np.uint8, np.uint64)

    @staticmethod
    def unpack(row: dict) -> Entries:
        return Entries(*(restored(row[c], t) for c, t in (("blob", np.uint8), ("lengths", np.uint32), ("classes", np.uint8), ("counts", np.uint64))))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("blob", "lengths", "classes", "counts")))


ENTRIES = "blob binary, lengths binary, classes binary, counts binary"


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    total = int(lengths.sum())
    ahead = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - ahead, lengths)] if total else np.zeros(0, np.uint8)


def distinct(parts: list[Entries]) -> Entries:
    """Equal pairs as one, with their counts added, in the order of the pairs' hashes."""
    all_ = Entries.joined(parts)
    _, pairs = all_.hashes()
    _, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
    out = all_.take(first)
    out.counts = np.zeros(len(first), np.uint64)
    np.add.at(out.counts, inverse, all_.counts)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


@dataclass
class Segments:
    """The segments of some rows: tokens in each, row, hash of itself, hash of its context (0 for none), of both."""

    sizes: np.ndarray
    rows: np.ndarray
    contexts: np.ndarray
    both: np.ndarray


def segments(t: Tokens) -> Segments:
    closes = (text.mixed(t.words + np.uint64(3)) % np.uint64(SEGMENT_WORDS) == 0) | (t.words == _END_HASH)
    ends = np.flatnonzero(closes) + 1
    if not len(ends):
        none = np.zeros(0, np.uint64)
        return Segments(none.astype(np.int64), none.astype(np.int64), none, none)
    starts = np.concatenate([[0], ends[:-1]])
    place = (np.arange(len(t.words)) - np.repeat(starts, ends - starts)).astype(np.uint64)
    own = text.mixed(np.add.reduceat(text.mixed(t.words + place * np.uint64(0x9E3779B97F4A7C15)), starts) + (ends - starts).astype(np.uint64))
    rows = t.rows[starts]
    contexts = np.zeros(len(own), np.uint64)
    contexts[1:] = np.where(rows[1:] == rows[:-1], text.mixed(own[:-1] + np.uint64(11)) | np.uint64(1), np.uint64(0))
    return Segments(ends - starts, rows, contexts, text.mixed(contexts * np.uint64(0xD6E8FEB86659FD93) ^ own) & ~np.uint64(1))


#: What a block is written as: its distinct pairs; its hashes of segments; its rows; hashes of some of its pairs with their bytes.
PAIRS, KEYS, ROWS, SOME = range(4)


class _Block:
    """Rows of one task until they are a block."""

    def __init__(self) -> None:
        self.n, self.ids, self.learn, self.entries, self.tokens, self.segments = 0, [], [], [], [], []

    def add(self, part: pa.RecordBatch) -> None:
        t = tokens(*text.joined(part.column("text")))
        learn = part.column("learn").to_numpy(zero_copy_only=False)
        pairs, first, inverse = np.unique(t.pairs, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=learn[t.rows], minlength=len(first)).astype(np.uint64)
        lengths = t.ends[first] - t.starts[first]
        self.entries.append(Entries(gather(t.data, t.starts[first], lengths), lengths.astype(np.uint32), t.classes[first], counts))
        sizes = np.bincount(t.rows, minlength=part.num_rows)
        self.tokens.append((pairs, inverse.astype(np.int32), sizes, np.bincount(t.rows, weights=t.ends - t.starts + 1, minlength=part.num_rows)))
        s = segments(t)
        self.segments.append((s.sizes, np.bincount(s.rows, minlength=part.num_rows), s.contexts, s.both, learn[s.rows]))
        self.ids.append(part.column("id"))
        self.learn.append(learn)
        self.n += len(t.words)

    def rows(self, block: int) -> Iterator[tuple]:
        entries = distinct(self.entries)
        _, pairs = entries.hashes()
        yield block, PAIRS, len(pairs), None, entries.pack()
        some = np.flatnonzero((pairs % np.uint64(SAMPLED) == 0) & (entries.counts > 0))  # of training texts: nothing of the model follows others
        yield block, SOME, len(some), None, [pairs[some].tobytes(), entries.lengths[some].astype(np.int64).tobytes()]
        sizes, of_row, contexts, both, learn = (np.concatenate(x) for x in zip(*self.segments))
        known = contexts != 0
        keys, inverse = np.unique(np.concatenate([contexts[known], both[known]]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.tile(learn[known], 2), minlength=len(keys)).astype(np.uint64)
        yield block, KEYS, len(keys), None, [squeezed(np.diff(keys, prepend=np.uint64(0))), squeezed(counts)]
        index = np.concatenate([np.searchsorted(pairs, mine).astype(np.uint32)[inverse] for mine, inverse, _, _ in self.tokens])
        n_tokens, n_bytes = (np.concatenate([x[k] for x in self.tokens]).astype(np.uint64) for k in (2, 3))
        parts = [squeezed(x) for x in (np.concatenate(self.learn).astype(np.uint8), n_tokens, n_bytes, index, sizes.astype(np.uint32), of_row.astype(np.uint32), known.astype(np.uint8), inverse.astype(np.uint32))]
        yield block, ROWS, sum(len(x) for x in self.ids), pa.chunked_array(self.ids).combine_chunks(), parts


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's rows. A block's number is unique among those of one run of the job."""
    block, number = _Block(), TaskContext.get().partitionId() << 32

    def written() -> Iterator[pa.RecordBatch]:
        for at, kind, n, ids, parts in block.rows(number):
            of = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.nulls(1, pa.list_(id_type))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), of, pa.array([parts], pa.list_(pa.binary()))], ["block", "kind", "n", "ids", "parts"])

    for batch in batches:
        id_type = batch.schema.field("id").type
        for part in text.steps(batch, "text"):
            block.add(part)
            if block.n >= most:
                yield from written()
                block, number = _Block(), number + 1
    if block.n:
        yield from written()


def _messages(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each block, cut by bucket."""
    for row in _rows(batches):
        entries = Entries(*(restored(x, t) for x, t in zip(row["parts"], Entries.TYPES)))
        _, pairs = entries.hashes()
        of = bucket_of(pairs, buckets)
        out = [[row["block"], int(k), *entries.take(np.flatnonzero(of == k)).pack()] for k in np.unique(of)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), *[pa.binary()] * 4])], ["block", "bucket", "blob", "lengths", "classes", "counts"])


def _key_messages(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The hashes of segments of each block, cut by bucket."""
    for row in _rows(batches):
        keys, counts = np.cumsum(restored(row["parts"][0], np.uint64)), restored(row["parts"][1], np.uint64)
        edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[k], edges[k + 1])
            yield _one(["block", "bucket", "keys", "counts"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], [row["block"], int(k), squeezed(np.diff(keys[mine], prepend=np.uint64(0))), squeezed(counts[mine])])


def _one(names: list[str], types: list[pa.DataType], row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)


def _key_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's hashes in a bucket their counts in all blocks. A bucket's messages follow one another; all of them are about BUCKET_KEYS hashes."""

    def emit() -> Iterator[pa.RecordBatch]:
        keys, inverse = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        totals = np.zeros(len(keys), np.uint64)
        np.add.at(totals, inverse, np.concatenate([c for _, _, c in parts]))
        at = 0
        for block, mine, _ in parts:
            yield _one(["block", "bucket", "counts"], [pa.int64(), pa.int32(), pa.binary()], [block, bucket, squeezed(totals[inverse[at : at + len(mine)]])])
            at += len(mine)

    bucket, parts = None, []
    for row in _rows(batches):
        if row["bucket"] != bucket and parts:
            yield from emit()
            parts = []
        bucket = row["bucket"]
        parts.append((row["block"], np.cumsum(restored(row["keys"], np.uint64)), restored(row["counts"], np.uint64)))
    if parts:
        yield from emit()


def _seen_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each segment of a block and its context were seen in other texts; the answers of a block come before its rows."""
    block, answers = None, []
    for row in _rows(batches):
        if row["block"] != block:
            block, answers = row["block"], []
        if row["counts"] is not None:
            answers.append(restored(row["counts"], np.uint64))
            continue
        learn, of_row, known, inverse = (restored(row["parts"][i], ROW_TYPES[i]) for i in (0, 5, 6, 7))
        trains = np.repeat(learn, of_row)[known > 0]
        of_text = np.repeat(np.arange(len(of_row)), of_row)[known > 0]
        totals = np.concatenate([np.zeros(0, np.uint64), *answers]).astype(np.int64)
        elsewhere = []
        for keys in np.split(inverse.astype(np.int64), 2):  # of contexts, then of segments behind them
            _, at, own = np.unique(of_text * max(1, len(totals)) + keys, return_inverse=True, return_counts=True)
            elsewhere.append(totals[keys] - trains * own[at])
        yield _one(["block", "context", "both", "trains"], [pa.int64(), *[pa.binary()] * 3], [block, *map(squeezed, elsewhere), squeezed(trains)])


ROW_TYPES = (np.uint8, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint32)


def segment_class(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By class of known contexts, how many segments of training texts were and were not behind them elsewhere."""
    out = np.zeros((2, SEGMENT_CLASSES), np.int64)
    for row in _rows(batches):
        context, both = restored(row["context"], np.int64), restored(row["both"], np.int64)
        counted = (context > 0) & (restored(row["trains"], np.uint8) > 0)
        for hit in (0, 1):
            out[hit] += np.bincount(segment_class(context[counted & ((both > 0) == hit)]), minlength=SEGMENT_CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENT_CLASSES), pa.int32()), pa.array(out[0]), pa.array(out[1])], ["class", "misses", "hits"])


def segment_logs(context: np.ndarray, both: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of the segments' decisions, and which are known behind their contexts. odds: by class, of a hit."""
    hit = both > 0
    rate = odds[segment_class(context)]
    logs = np.where(context > 0, np.where(hit, np.log10(rate), np.log10(1 - rate)), 0.0)
    return logs + np.where(hit, np.log10(np.maximum(1, both)) - np.log10(np.maximum(1, context)), 0.0), hit


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket follow one another; each bucket's pairs become one, and get the counts of their words."""

    def emit(parts: list[Entries]) -> Iterator[pa.RecordBatch]:
        entries = distinct(parts)
        words, _ = entries.hashes()
        _, inverse = np.unique(words, return_inverse=True)
        of_word = np.zeros(int(inverse.max()) + 1, np.uint64)
        np.add.at(of_word, inverse, entries.counts)
        word_counts = of_word[inverse]
        known = int((of_word > 0).sum())
        order = np.argsort(entries.counts == 0, kind="stable")  # what trains first, so that its steps do not depend on other texts
        for at in range(0, len(words), 1 << 16):
            index = order[at : at + (1 << 16)]
            total = int(entries.counts.sum()) if at == 0 else 0
            row = [bucket, *entries.take(index).pack(), squeezed(word_counts[index]), total, known if at == 0 else 0]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()])], ["bucket", "blob", "lengths", "classes", "counts", "word_counts", "total", "known"])

    bucket, parts = None, []
    for row in _rows(batches):
        if row["bucket"] != bucket and parts:
            yield from emit(parts)
            parts = []
        bucket = row["bucket"]
        parts.append(Entries.unpack(row))
        if len(parts) >= 64:
            parts = [distinct(parts)]
    if parts:
        yield from emit(parts)


# -- the model -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """The decisions of byte b are nodes[first[b]:first[b + 1]], with their outcomes in bits."""

    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """A Huffman tree over all 256 bytes; a floor of total / 65,536 keeps paths short."""
    floor = max(1, int(counts.sum()) >> 16)
    heap: list[tuple[int, int, object]] = [(int(c) + floor, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    number = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], number, (a[2], b[2])))
        number += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    node, open_ = 0, [(heap[0][2], [])]
    while open_:
        at, path = open_.pop()
        if isinstance(at, int):
            paths[at] = path
            continue
        here, node = node, node + 1
        open_ += [(at[1], [*path, (here, 1)]), (at[0], [*path, (here, 0)])]
    flat = [x for path in paths for x in path]
    return Tree(np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32), np.array([x[0] for x in flat], np.uint32), np.array([x[1] for x in flat], np.uint8))


def byte_counts(entries: Entries) -> np.ndarray:
    """How often each byte stands in the training text of the entries."""
    weights = np.repeat(entries.counts, entries.lengths.astype(np.int64)).astype(np.float64)
    out = np.bincount(entries.blob, weights=weights, minlength=256).astype(np.int64)
    ends = entries.lengths == 0
    out[END] += int(entries.counts[ends].sum())
    out[SPACE] += int(entries.counts[~ends].sum())
    return out


_NODE_HASH = text.mixed(np.arange(256, dtype=np.uint64) + np.uint64(77)).astype(np.uint32)


def decisions(entries: Entries, tree: Tree, sizes_of_tables: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slots of each context, outcomes, entry of each decision) of the entries written as bytes."""
    n = len(entries.lengths)
    sizes = entries.lengths.astype(np.int64) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.full(offsets[-1], SPACE, np.uint8)
    entry = np.repeat(np.arange(n), sizes)
    into = np.arange(len(data)) - offsets[entry]
    data[into < sizes[entry] - 1] = entries.blob
    data[offsets[:-1][entries.lengths == 0]] = END
    # what stands before: the word so far, a space, the last byte of the word before
    recent = np.zeros(len(data), np.uint64)
    classes = entries.classes[entry].astype(np.uint64)
    histories = {}
    for j in range(1, max(ORDERS) + 1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j]
        before = np.where(into >= j, before, np.where(into == j - 1, np.uint64(SPACE), np.where(into == j - 2, classes, np.uint64(0))))
        recent = recent | before << np.uint64(8 * (j - 1))
        histories[j] = recent
    so_far = text.SpanHash(data).of(offsets[entry], np.arange(len(data)))
    contexts = [
        *(text.mixed(histories[j] + np.uint64(j << 56)) for j in ORDERS),
        text.mixed(so_far + np.uint64(5)),
        text.mixed(so_far + (classes + np.uint64(6)) * np.uint64(0x9E3779B97F4A7C15)),
    ]
    lengths = (tree.first[1:] - tree.first[:-1])[data]
    ends = np.cumsum(lengths, dtype=np.int64)
    code = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - tree.first[data], lengths)
    nodes = _NODE_HASH[tree.nodes[code]]
    slots = [((np.repeat((c >> np.uint64(24)).astype(np.uint32), lengths) ^ nodes) & np.uint32(size - 1)).astype(np.intp) for c, size in zip(contexts, sizes_of_tables)]
    return slots, tree.bits[code], np.repeat(entry, lengths)


def quantised(counts: np.ndarray) -> np.ndarray:
    """A byte for each count: five steps for each doubling of 1 + count, up to 2^51, so that tables stay small."""
    return np.minimum(255, np.round(5 * np.log2(1.0 + counts))).astype(np.uint8)


def _by_code(of_counts) -> np.ndarray:
    """A value for each 16-bit code of two quantised counts: zeros + 256 * ones."""
    count = 2 ** (np.arange(256) / 5) - 1
    return of_counts(count[None, :], count[:, None]).reshape(-1)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((np.maximum(0, ones) + PRIOR) / (np.maximum(0, zeros) + PRIOR)).astype(np.float32)


#: By code: log-odds; those without one own occurrence of a zero, then of a one; and how often the slot was seen.
ODDS = _by_code(_odds)
ODDS_LEFT_OUT = np.concatenate([_by_code(lambda zeros, ones: _odds(zeros - 1, ones)), _by_code(lambda zeros, ones: _odds(zeros, ones - 1))])
SEEN_CLASS = _by_code(lambda zeros, ones: np.searchsorted(SEEN, np.round(zeros + ones), "right").astype(np.int8))


def coded(counts: np.ndarray) -> np.ndarray:
    """(slots, 2) quantised counts as the codes of the tables above."""
    return np.ascontiguousarray(counts).view("<u2").reshape(-1).astype(np.uint16)


def _inputs(tables: list[np.ndarray], slots: list[np.ndarray], bits: np.ndarray, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (CONTEXTS, decisions) and gates; with `left_out` each decision's own occurrence is not counted."""
    odds = np.empty((CONTEXTS, len(bits)), np.float32)
    codes = [table[slot] for table, slot in zip(tables, slots)]
    own = bits.astype(np.uint32) << np.uint32(16)
    for k, code in enumerate(codes):
        odds[k] = ODDS_LEFT_OUT[code + own] if left_out else ODDS[code]
    seen = SEEN_CLASS[codes[-2]]
    if left_out:  # a slot that only the decision itself was counted in is not known
        seen *= (seen > 1) | (odds[-2] != 0)
    longest = np.maximum((odds[-1] != 0) * np.int8(2), odds[1] != 0)
    return odds, (seen * np.int8(3) + longest).astype(np.intp)


def _mixed(inputs: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    of_context = weights.T.astype(np.float32)
    z = inputs[0] * of_context[0][gate]
    for k in range(1, CONTEXTS):
        z += inputs[k] * of_context[k][gate]
    return z


START = np.full((GATES, CONTEXTS), 0.25, np.float32)


def refine(tables: list[np.ndarray], tree: Tree, entries: Entries, weights: np.ndarray, mass: np.ndarray, rate: float = RATE) -> None:
    """Online steps over the entries that training texts have, STEP at a time; adds to the gates' mass.

    A step goes along the mean gradient of the gate's decisions, each weighted by its multiplicity. Shorter steps
    follow where a gate has seen more.
    """
    known = np.flatnonzero(entries.counts)
    # in the order of their hashes, so that no step has one part of the alphabet only
    for at in range(0, len(known), STEP):
        mine = entries.take(known[at : at + STEP])
        slots, bits, entry = decisions(mine, tree, [len(x) for x in tables])
        inputs, gate = _inputs(tables, slots, bits, True)
        share = mine.counts.astype(np.float64)[entry]
        z = _mixed(inputs, gate, weights)
        push = share * (bits - 1 / (1 + np.exp(-np.maximum(z, np.float32(-80)))))
        here = np.bincount(gate, weights=share, minlength=GATES)
        power = np.bincount(gate, weights=share * (inputs * inputs).sum(axis=0), minlength=GATES)
        step = rate / np.sqrt(1 + mass / (mass[mass > 0].mean() if mass.any() else 1))
        for k in range(CONTEXTS):
            weights[:, k] += step * np.bincount(gate, weights=push * inputs[k], minlength=GATES) / np.maximum(1, power / CONTEXTS)
        mass += here


def log10_probabilities(tables: list[np.ndarray], tree: Tree, entries: Entries, weights: np.ndarray) -> np.ndarray:
    """log10 of the probability of each entry's bytes behind the byte of its class."""
    out = np.zeros(len(entries.lengths))
    for at in range(0, len(out), STEP):
        index = np.arange(at, min(len(out), at + STEP))
        slots, bits, entry = decisions(entries.take(index), tree, [len(x) for x in tables])
        inputs, gate = _inputs(tables, slots, bits, False)
        z = _mixed(inputs, gate, weights) * (bits.astype(np.float32) * 2 - 1)
        cost = np.log1p(np.exp(-np.maximum(z, np.float32(-80))))
        out[index] = -np.bincount(entry, weights=cost, minlength=len(index)) / np.log(10)
    return out


# -- the jobs ------------------------------------------------------------------------------------------------


def add_up(tables: list[np.ndarray], tree: Tree, entries: Entries) -> None:
    """Adds the decisions of all training occurrences to the counts (slots, 2) of each context."""
    known = np.flatnonzero(entries.counts)
    for at in range(0, len(known), STEP):
        mine = entries.take(known[at : at + STEP])
        slots, bits, entry = decisions(mine, tree, [len(x) for x in tables])
        times = mine.counts[entry].astype(tables[0].dtype)
        for k, table in enumerate(tables):
            np.add.at(table.reshape(-1), slots[k] * 2 + bits, times)


def table_sizes(distinct_bytes: int) -> list[int]:
    """Slots of each context: powers of two that follow the bytes of distinct words."""
    return [min(MOST_SLOTS, max(LEAST_SLOTS, 1 << math.ceil(math.log2(1 + share * distinct_bytes)))) for share in SLOTS_PER_BYTE]


def _tables(lexicon: DataFrame, tree: Tree, parts: int, sizes: list[int], train_bytes: int) -> list[np.ndarray]:
    """Quantised counts of all training decisions: partial tables of the tasks, added up in two rounds of shuffles."""
    kind = np.uint32 if train_bytes < 2**32 else np.uint64  # a slot counts each byte of the corpus once at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, salt = [np.zeros((size, 2), kind) for size in sizes], 0
        for row in _rows(batches):
            salt = row["bucket"]
            add_up(tables, tree, Entries.unpack(row))
        for k, table in enumerate(tables):
            for chunk in range(2 * sizes[k] // _CHUNK):
                values = table.reshape(-1)[chunk * _CHUNK : (chunk + 1) * _CHUNK]
                if values.any():
                    yield _chunk_row(k, chunk, salt, values.astype(np.uint64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        salt = 0
        for row in _rows(batches):
            key, salt = (row["k"], row["chunk"]), row["salt"]
            values = restored(row["sums"], np.uint64)
            sums[key] = sums[key] + values if key in sums else values
        for (k, chunk), values in sums.items():
            yield _chunk_row(k, chunk, salt, values)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            row = batch.to_pylist()[0]
            yield _chunk_row(row["k"], row["chunk"], row["salt"], quantised(restored(row["sums"], np.uint64)))

    schema = "k int, chunk int, salt int, sums binary"
    found = lexicon.select("bucket", "blob", "lengths", "classes", "counts").mapInArrow(count, schema)
    found = found.withColumn("salt", F.pmod("salt", F.lit(max(1, round(parts**0.5))))).repartition("k", "chunk", "salt").mapInArrow(add, schema)
    found = found.repartition("k", "chunk").mapInArrow(small, schema)
    out = [np.zeros(2 * size, np.uint8) for size in sizes]
    for row in found.collect():  # no more than the tables' fixed size
        out[row["k"]][row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = restored(row["sums"], np.uint8)
    return [coded(x.reshape(-1, 2)) for x in out]


def _chunk_row(k: int, chunk: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, chunk, salt, squeezed(values)), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["k", "chunk", "salt", "sums"])


def _weights(lexicon: DataFrame, tables, tree: Tree) -> np.ndarray:
    """The mean of the weights that each task has refined, by the mass of its gates; unseen gates keep the start."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mass = START.copy().astype(np.float64), np.zeros(GATES)
        for row in _rows(batches):
            refine(tables.value, tree, Entries.unpack(row), weights, mass)
        yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), pa.array(mass), *(pa.array(weights[:, k] * mass) for k in range(CONTEXTS))], ["gate", "mass", *(f"w{k}" for k in range(CONTEXTS))])

    schema = "gate int, mass double, " + ", ".join(f"w{k} double" for k in range(CONTEXTS))
    learnt = lexicon.select("bucket", "blob", "lengths", "classes", "counts").mapInArrow(learn, schema)
    out = START.copy()
    for row in learnt.groupBy("gate").agg(F.sum("mass").alias("mass"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(CONTEXTS))).where("mass > 0").collect():
        out[row["gate"]] = [row[f"w{k}"] / row["mass"] for k in range(CONTEXTS)]
    return out


def score(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_bytes: int = BUCKET_BYTES, bucket_keys: int = BUCKET_KEYS, passages: bool = True) -> DataFrame:
    """One row per row of `documents`: id, n_tokens, n_known, train_tokens, base_score, score, n_coded_bytes.

    `learn` says which rows train (null: no). base_score is the log10 probability by add-one token counts of the
    training rows, score by the mixed model, in which a training row's passages are not predicted from themselves.
    Null and empty texts have their end only. Without training rows every slot is empty and all decisions are even.
    Repeated rows are scored each. -score / log10(2) / n_coded_bytes is the bits per byte. Without `passages` all texts are
    spelt, so that the score is that of the letters alone.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    read = graph.cut(rows.mapInArrow(lambda batches: _blocks(batches, block_tokens), f"block bigint, kind int, n bigint, ids array<{kind}>, parts array<binary>"))
    of = lambda k: read.where(F.col("kind") == k)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row["parts"]], ["pair", "size"])

    lengths = of(SOME).select("parts").mapInArrow(some, "pair bigint, size bigint").groupBy("pair").agg(F.min("size").alias("size"))
    distinct_bytes = SAMPLED * (lengths.agg(F.coalesce(F.sum(F.col("size") + 1), F.lit(0))).first()[0])
    n_keys = of(KEYS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets, key_buckets = distinct_bytes // bucket_bytes + 1, n_keys // bucket_keys + 1

    asked = of(PAIRS).select("block", "parts").mapInArrow(lambda batches: _messages(batches, buckets), f"block bigint, bucket int, {ENTRIES}")
    lexicon = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_lexicon, f"bucket int, {ENTRIES}, word_counts binary, total bigint, known bigint")
    lexicon = graph.cut(lexicon)
    n, v = (x or 0 for x in lexicon.agg(F.sum("total"), F.sum("known")).first())

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(256, np.int64)
        for row in _rows(batches):
            out += byte_counts(Entries.unpack(row))
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(out)], ["byte", "n"])

    seen = np.zeros(256, np.int64)
    for row in lexicon.select("bucket", "blob", "lengths", "classes", "counts").mapInArrow(histogram, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        seen[row["byte"]] = row["n"]
    tree = huffman(seen)
    tables = spark.sparkContext.broadcast(_tables(lexicon, tree, buckets, table_sizes(distinct_bytes), int(seen.sum())))
    weights = _weights(lexicon, tables, tree)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            entries = Entries.unpack(row)
            _, pairs = entries.hashes()
            logs = log10_probabilities(tables.value, tree, entries, weights)
            yield _one(["bucket", "pairs", "word_counts", "logs"], [pa.int32(), *[pa.binary()] * 3], [row["bucket"], squeezed(pairs), row["word_counts"], squeezed(logs.astype(np.float32))])

    known = lexicon.mapInArrow(scored, "bucket int, pairs binary, word_counts binary, logs binary")
    none = F.lit(None)
    both = known.select("bucket", F.lit(-1).cast("bigint").alias("block"), "pairs", "word_counts", "logs", *(none.cast("binary").alias(c) for c in ("blob", "lengths", "classes", "counts")))
    both = both.unionByName(asked.select("bucket", "block", *(none.cast("binary").alias(c) for c in ("pairs", "word_counts", "logs")), "blob", "lengths", "classes", "counts"))
    answers = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answers, "block bigint, bucket int, word_counts binary, logs binary")

    met = _met_segments(of(KEYS), of(ROWS), key_buckets)
    odds = np.full(SEGMENT_CLASSES, 0.5)
    for row in met.mapInArrow(_hits, "class int, misses bigint, hits bigint").groupBy("class").agg(F.sum("misses").alias("misses"), F.sum("hits").alias("hits")).collect():
        odds[row["class"]] = (row["hits"] + 0.5) / (row["hits"] + row["misses"] + 1)

    empty = lambda *names: [none.cast("binary").alias(c) for c in names]
    meet = answers.select("block", F.lit(0).alias("kind"), "bucket", "word_counts", "logs", *empty("context", "both"), none.cast(f"array<{kind}>").alias("ids"), none.cast("array<binary>").alias("parts"))
    meet = meet.unionByName(met.select("block", F.lit(1).alias("kind"), F.lit(0).alias("bucket"), *empty("word_counts", "logs"), "context", "both", none.cast(f"array<{kind}>").alias("ids"), none.cast("array<binary>").alias("parts")))
    meet = meet.unionByName(of(ROWS).select("block", F.lit(2).alias("kind"), F.lit(0).alias("bucket"), *empty("word_counts", "logs", "context", "both"), "ids", "parts"))
    meet = meet.repartition("block").sortWithinPartitions("block", "kind", "bucket")
    out = meet.mapInArrow(lambda batches: _sums(batches, int(n), int(v), odds if passages else None), f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_coded_bytes bigint")
    return out.withColumnRenamed("id", id_col)


def _met_segments(keys: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """(block, context, both, trains): how often each segment with a context, and that context, were seen in other texts."""
    sent = keys.select("block", "parts").mapInArrow(lambda batches: _key_messages(batches, buckets), "block bigint, bucket int, keys binary, counts binary")
    counts = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_key_answers, "block bigint, bucket int, counts binary")
    # of the rows only what says where their segments are
    short = F.transform("parts", lambda x, i: F.when(i.isin(0, 5, 6, 7), x))
    meet = counts.withColumn("parts", F.lit(None).cast("array<binary>")).unionByName(rows.select("block", F.lit(2**31 - 1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), short.alias("parts")))
    return graph.cut(meet.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_seen_segments, "block bigint, context binary, both binary, trains binary"))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's message to a bucket, what the bucket knows of its pairs, in the block's order; the bucket's own rows come first."""
    bucket, own, table = None, [], None
    for row in _rows(batches):
        if row["bucket"] != bucket:
            bucket, own, table = row["bucket"], [], None
        if row["block"] < 0:
            own.append([restored(row[c], t) for c, t in (("pairs", np.uint64), ("word_counts", np.uint64), ("logs", np.float32))])
            continue
        if table is None:
            table = [np.concatenate(x) for x in zip(*own)]
            order = np.argsort(table[0])
            table, own = [x[order] for x in table], []
        _, pairs = Entries.unpack(row).hashes()
        at = np.searchsorted(table[0], pairs)
        yield _one(["block", "bucket", "word_counts", "logs"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], [row["block"], bucket, squeezed(table[1][at]), squeezed(table[2][at])])


def _sums(batches: Iterator[pa.RecordBatch], n: int, v: int, odds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens of each text of what its block's answers say; a block's answers come before its texts."""
    block, answers, seen = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            if row["block"].as_py() != block:
                block, answers, seen = row["block"].as_py(), [], None
            if row["kind"].as_py() == 0:
                answers.append([restored(row[c].as_py(), t) for c, t in (("word_counts", np.uint64), ("logs", np.float32))])
            elif row["kind"].as_py() == 1:
                seen = [restored(row[c].as_py(), np.int64) for c in ("context", "both")]
            else:
                yield from _summed(row["ids"].values, row["parts"].as_py(), [np.concatenate(x) for x in zip(*answers)], seen, n, v, odds)
                answers, seen = [], None


def _summed(ids: pa.Array, parts: list[bytes], answers: list[np.ndarray], seen: list[np.ndarray], n: int, v: int, odds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows of a block, some SUMMED_TOKENS at a time. odds: None if all segments are spelt."""
    _, n_tokens, n_bytes, index, sizes, of_row, known, _ = (restored(x, t) for x, t in zip(parts, ROW_TYPES))
    word_counts, logs = answers
    base_logs, is_known = np.log10(word_counts.astype(np.float64) + 1), word_counts > 0
    decided, hit = segment_logs(*seen, odds) if odds is not None else (np.zeros(len(seen[0])), np.zeros(len(seen[0]), bool))
    ends, segment_ends, seen_ends = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (n_tokens, of_row, known))
    at = 0
    while at < len(n_tokens):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SUMMED_TOKENS, "right")) - 1)
        rows, mine = to - at, index[ends[at] : ends[to]]
        size = n_tokens[at:to].astype(np.int64)
        first = ends[at:to] - ends[at]  # every row has its end at least
        base = np.add.reduceat(base_logs[mine], first) - size * np.log10(n + v + 1)
        n_known = np.add.reduceat(is_known[mine].astype(np.int64), first)
        a, b = segment_ends[at], segment_ends[to]
        spelt = np.add.reduceat(logs[mine].astype(np.float64), np.cumsum(sizes[a:b].astype(np.int64)) - sizes[a:b])
        with_context = known[a:b] > 0
        of_segment, by_passage = np.zeros(b - a), np.zeros(b - a, bool)
        of_segment[with_context], by_passage[with_context] = decided[seen_ends[a] : seen_ends[b]], hit[seen_ends[a] : seen_ends[b]]
        total = np.add.reduceat(of_segment + np.where(by_passage, 0.0, spelt), segment_ends[at:to] - a)
        columns = [ids.slice(at, rows), pa.array(size), pa.array(n_known), pa.array(np.full(rows, n), pa.int64()), pa.array(base), pa.array(total), pa.array(n_bytes[at:to].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_coded_bytes"])
        at = to
