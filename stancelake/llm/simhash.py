"""SimHash near-duplicates found with BK-trees.

A text's fingerprint is the majority of the 64-bit hashes of its word shingles, and of fixed bijections of
them where more than 64 bits are asked for. Texts link when their fingerprints differ in at most `radius`
bits. Fingerprints are first made distinct, so exact copies never multiply work, and dealt to shards such
that any two that link meet in one shard at least:

- by_blocks: the bits are cut into blocks, and each choice of blocks that `radius` flips cannot all reach is a
  key (pigeonhole, so no link is lost);
- by_anchors: for radii of a large share of the bits, where blocks would be a bit or two, the keys are bands
  of least shingle hashes, which two texts of similarity s share with probability 1 - (1 - s^2)^bands.

Each shard has a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows
only the edges within the radius of its own distance. A shard of over `most` fingerprints is cut into pieces;
the tree of each piece goes to the tasks that hold the searches of each other piece, so no task or tree grows
with a hot group. Shards give spanning links only, never all pairs; components come from graph.components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm import graph, text

#: Most fingerprints in one tree.
MOST = 2048

SEED = 42

#: Bits of the hash of a shingle set that follow its fingerprint where sets are told apart.
SET_BITS = 128


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words joined by spaces; of all words if there are fewer; empty for none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(size)))
    return np.fromiter((digest(join(run), SEED) for run in runs), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row of hashes[offsets[i]:offsets[i+1]] the bits that over half of them have; 0 for no hashes.

    Eight bits are counted at a time in the eight bytes of a word, in runs of at most 255 hashes.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    runs = (sizes[full] + 254) // 255
    first_run = np.cumsum(runs) - runs
    begin = np.repeat(offsets[:-1][full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for bit in range(8):
        ones = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        bytes_of = np.add.reduceat(ones, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(bytes_of.astype(np.int64), first_run, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _lane(hashes: np.ndarray, k: int) -> np.ndarray:
    return hashes if k == 0 else text.mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _set_hash(shingles: np.ndarray) -> bytes:
    """Of sorted distinct hashes."""
    return xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 64, bands: int = 0, of_sets: bool = False) -> DataFrame:
    """(id, fingerprint binary of bits / 8 bytes, most significant first, anchors array<bigint>) of every row.

    Null and empty texts have the fingerprint zero and no anchors. Whole texts; no shuffle. `of_sets` counts each
    shingle of a text once and adds the hash of its set, SET_BITS / 8 bytes, behind the fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, "text"):
                each = [shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in part.column("text").cast(pa.large_binary())]
                each = [np.unique(x) for x in each] if of_sets else each
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                hashes = np.concatenate([np.zeros(0, np.uint64), *each])
                lanes = np.stack([majority(_lane(hashes, k), offsets) for k in range(bits // 64)], axis=1)
                raw, wide = lanes.astype(">u8").tobytes(), bits // 8
                prints = [raw[i * wide : (i + 1) * wide] + (_set_hash(x) if of_sets else b"") for i, x in enumerate(each)]
                anchors = [[] for _ in each]
                full = np.flatnonzero(np.diff(offsets))
                if bands and len(full):
                    least = [np.minimum.reduceat(_lane(hashes, 100 + k), offsets[:-1][full]) for k in range(2 * bands)]
                    keys = [text.mixed(least[2 * k] ^ text.mixed(least[2 * k + 1] + np.uint64(k))).view(np.int64) for k in range(bands)]
                    for i, row in zip(full, np.stack(keys, axis=1).tolist()):
                        anchors[i] = row
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["id", "fingerprint", "anchors"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint binary, anchors array<bigint>")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it, of all bits but the last `tail`."""

    def __init__(self, tail: int = 0) -> None:
        self.tail = tail
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        value >>= self.tail
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values at `radius` or less; follows only edges from distance - radius to distance + radius."""
        found, open_ = [], [0] if self.values else []
        value >>= self.tail
        while open_:
            at = open_.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(child)
        return found


def spanning_links(tree_values: list[int], searches: list[int] | None, radius: int, tail: int = 0) -> list[tuple[int, int]]:
    """Links (smaller, larger) that connect what lies within the radius of each other.

    searches None: among the values of the tree; otherwise between them and the searches. The last `tail` bits
    tell values apart but are no part of the distance.
    """
    values = tree_values + (searches or [])
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree(tail)
    if searches is None:
        for i, value in enumerate(tree_values):
            for j in tree.within(value, radius):
                parent[root(j)] = root(i)
            tree.add(value)
    else:
        for value in tree_values:
            tree.add(value)
        for i, value in enumerate(searches, len(tree_values)):
            for j in tree.within(value, radius):
                parent[root(j)] = root(i)
    groups: dict[int, list[int]] = {}
    for i, value in enumerate(values):
        groups.setdefault(root(i), []).append(value)
    return [(least, x) for members in groups.values() if len(members) > 1 for least in [min(members)] for x in members if x != least]


def _by_blocks(distinct: DataFrame, bits: int, radius: int, blocks: int | None) -> DataFrame:
    """One row per fingerprint of at most 64 bits and choice of blocks; key hashes the chosen blocks' bits and the choice."""
    blocks = blocks or radius + 1
    edges = [bits * i // blocks for i in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), blocks - radius))
    as_bits = F.lpad(F.conv(F.hex("fingerprint"), 16, 2), bits, "0")
    pieces = lambda choice: F.concat(*[F.substring("bits", edges[i] + 1, edges[i + 1] - edges[i]) for i in choice])
    keys = [F.xxhash64(F.lit(k), pieces(choice)) for k, choice in enumerate(choices)]
    return distinct.select("fingerprint", as_bits.alias("bits")).select("fingerprint", F.explode(F.array(*keys)).alias("key"))


def blocks_for(n: int, bits: int, radius: int, most: int = MOST) -> int:
    """Blocks that n fingerprints of random bits are cut into, so that a key is shared by about `most` at most.

    One block more than the radius gives few, short keys; each further one gives more and longer keys, and no
    link is lost with any number.
    """
    blocks = radius + 1
    while blocks < 2 * radius and n >> (bits * (blocks - radius) // blocks) > most:
        blocks += 1
    return blocks


def links(distinct: DataFrame, bits: int, radius: int, blocks: int | None = None, anchored: bool = False, most: int = MOST, tail: int = 0) -> DataFrame:
    """(a, b) spanning links of distinct fingerprints (fingerprint, anchors if `anchored`) within the radius.

    `tail` bits behind the fingerprint's own tell its rows apart.
    """
    if anchored:
        rows = distinct.select("fingerprint", F.explode("anchors").alias("key"))
    else:
        rows = _by_blocks(distinct, bits, radius, blocks)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / most).cast("int")
    rows = rows.join(sizes, "key").select("key", "fingerprint", pieces.alias("pieces"), F.pmod(F.xxhash64("fingerprint", F.lit(7)), pieces).cast("int").alias("mine"))
    rows = rows.select("key", "fingerprint", "mine", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fingerprint")
    dealt = rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "mine", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, left, right, out = None, [], [], []

        def close() -> None:
            if open_key is not None:
                same = open_key[1] == open_key[2]
                if len(left) > 1 if same else left and right:
                    out.extend(spanning_links(left, None if same else right, radius, tail))

        wide = (bits + tail) // 8
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))
            for key, mine, value in zip(keys, batch.column("mine").to_pylist(), batch.column("fingerprint").to_pylist()):
                if key != open_key:
                    close()
                    open_key, left, right = key, [], []
                (left if mine == key[1] else right).append(int.from_bytes(value, "big"))
            if len(out) > 10_000:
                yield _pairs(out, wide)
                out = []
        close()
        yield _pairs(out, wide)

    return dealt.mapInArrow(run, "a binary, b binary")


def _pairs(out: list[tuple[int, int]], wide: int) -> pa.RecordBatch:
    columns = [pa.array([x[i].to_bytes(wide, "big") for x in out], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def radius_for(similarity: float, bits: int, margin: float = 0.5) -> int:
    """Expected differing bits of two shingle sets of that Jaccard similarity, plus `margin` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def radius_of_sets(similarity: float, bits: int, margin: float = 4, largest: int = 64) -> int:
    """Expected differing bits plus `margin` standard deviations, of the sets of that similarity or more that differ most.

    Sets of up to `largest` shingles have the exact distribution of their majorities, with its ties; larger
    ones come near to that of radius_for.
    """

    def at_least(n: int, least: int) -> float:
        return sum(math.comb(n, k) for k in range(max(0, least), n + 1)) / 2**n

    def differing(common: int, left: int, right: int) -> float:
        """Probability that the majorities of `common` + `left` and of `common` + `right` fair bits differ."""
        total = 0.0
        for k in range(common + 1):
            a, b = (at_least(n, (common + n) // 2 + 1 - k) for n in (left, right))
            total += math.comb(common, k) / 2**common * (a + b - 2 * a * b)
        return total

    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for m in range(1, largest + 1):
        for n in range(m, math.floor(m / similarity + 1e-9) + 1):
            common = math.ceil(similarity * (m + n) / (1 + similarity) - 1e-9)
            p = max(p, differing(common, m - common, n - common))
    return round(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 64, radius: int = 3, blocks: int | None = None, bands: int = 0, most: int = MOST) -> DataFrame:
    """(id, fingerprint, component) of every row: the smallest id that links of at most `radius` bits reach.

    bands 0: shards by blocks, exact; their number follows that of distinct fingerprints unless it is given. bands > 0: shards by anchors. All rows of an id keep their own
    fingerprints; rows with a null id are in classes, but name none. Empty texts are one class.
    """
    rows = graph.cut(fingerprints(documents, id_col, text_col, size, bits, bands))
    distinct = rows.groupBy("fingerprint").agg(F.min("id").alias("least"), *([F.min("anchors").alias("anchors")] if bands else []))
    distinct = graph.cut(distinct)
    blocks = blocks or blocks_for(distinct.count(), bits, radius)
    roots = graph.components(links(distinct, bits, radius, blocks, bool(bands), most))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select("fingerprint", "component")
    return rows.select("id", "fingerprint").join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component")


def _sets(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """(fingerprint and set hash, shingles: sorted distinct hashes as bytes) of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("text"):
                hashes = np.unique(shingle_hashes((raw.as_py() or "").encode(), size))
                lanes = np.concatenate([majority(_lane(hashes, k), np.array([0, len(hashes)])) for k in range(bits // 64)])
                columns = [pa.array([lanes.astype(">u8").tobytes() + _set_hash(hashes)], pa.binary()), pa.array([hashes.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["fingerprint", "shingles"])

    return rows.select("text").mapInArrow(run, "fingerprint binary, shingles binary")


def _verified(rows: DataFrame, bits: int, radius: int, similarity: float, most: int, most_bytes: int) -> DataFrame:
    """(a, b) spanning links among the fingerprints of each root whose shingle sets are that similar.

    rows: root, fingerprint, shingles. A root of over `most` fingerprints or `most_bytes` of shingles is cut into
    pieces that meet two by two, as shards are.
    """
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("size"))
    pieces = F.ceil(F.greatest(F.col("n") / most, F.col("size") / most_bytes)).cast("int")
    rows = rows.join(sizes, "root").withColumn("pieces", F.greatest(F.lit(1), pieces))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fingerprint", F.lit(11)), F.col("pieces")).cast("int"))
    rows = rows.select("root", "fingerprint", "shingles", "mine", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    rows = rows.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fingerprint", "shingles")
    dealt = rows.repartition(F.col("root"), F.col("i"), F.col("j")).sortWithinPartitions("root", "i", "j", "mine", "fingerprint")

    def linked(members: list[tuple[int, bool, np.ndarray]], same: bool) -> list[tuple[int, int]]:
        parent = list(range(len(members)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        tree, held = BKTree(SET_BITS), []
        for i, (value, left, shingles) in enumerate(members):
            if same or not left:
                near = sorted(tree.within(value, radius), key=lambda k: (value >> SET_BITS ^ tree.values[k]).bit_count())
                for j in (held[k] for k in near):
                    if root(i) != root(j):
                        both = len(np.intersect1d(shingles, members[j][2], assume_unique=True))
                        if both >= similarity * (len(shingles) + len(members[j][2]) - both):
                            parent[root(j)] = root(i)
            if same or left:
                tree.add(value)
                held.append(i)
        return [(members[root(i)][0], x[0]) for i, x in enumerate(members) if root(i) != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, members, wide = None, [], (bits + SET_BITS) // 8
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["root"], row["i"], row["j"])
                if key != open_key:
                    if members:
                        yield _pairs(linked(members, open_key[1] == open_key[2]), wide)
                    open_key, members = key, []
                members.append((int.from_bytes(row["fingerprint"], "big"), row["mine"] == row["i"], np.frombuffer(row["shingles"], np.uint64)))
        if members:
            yield _pairs(linked(members, open_key[1] == open_key[2]), wide)

    return dealt.mapInArrow(run, "a binary, b binary")


def similar_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bits: int = 512, bands: int = 8, most: int = MOST, most_bytes: int = 32 << 20) -> DataFrame:
    """(id, fingerprint, component) of every row: the smallest id that links of near copies reach.

    Texts link if the Jaccard similarity of their sets of `size`-word shingles is at least `similarity`. Wide
    fingerprints of those sets, anchored shards and a radius four standard deviations beyond the expected distance
    find the candidates; then the shingle sets of candidates, and of no other row, are compared exactly.
    Equal sets are one text here, equal fingerprints of other sets are not. Null and empty texts are one class; rows
    with a null id name none.
    """
    rows = _similar(documents, id_col, text_col, size, similarity, bits, bands, most, most_bytes)
    return rows.select(F.col("id").alias(id_col), F.substring("fingerprint", 1, bits // 8).alias("fingerprint"), "component")


def _similar(documents: DataFrame, id_col: str, text_col: str, size: int = 5, similarity: float = 0.8, bits: int = 512, bands: int = 8, most: int = MOST, most_bytes: int = 32 << 20) -> DataFrame:
    """(id, fingerprint and hash of the set, root: a fingerprint that names the class, component) of every row."""
    radius = radius_of_sets(similarity, bits)
    rows = graph.cut(fingerprints(documents, id_col, text_col, size, bits, bands, of_sets=True))
    distinct = graph.cut(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.min("anchors").alias("anchors")))
    roots = graph.cut(graph.components(links(distinct, bits, radius, anchored=True, most=most, tail=SET_BITS)))
    few = distinct.join(roots, distinct["fingerprint"] == roots["node"]).select("root", "fingerprint", "least")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = texts.join(few.select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    # a candidate that only rows without id have is found among those by its fingerprint
    texts = named if few.where("least IS NULL").isEmpty() else named.unionByName(texts.where("id IS NULL"))
    sets = few.select("root", "fingerprint").join(_sets(texts, size, bits).dropDuplicates(["fingerprint"]), "fingerprint")
    checked = graph.components(_verified(sets, bits, radius, similarity, most, most_bytes))
    rooted = distinct.join(checked, distinct["fingerprint"] == checked["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select("fingerprint", "root", "component")
    return rows.select("id", "fingerprint").join(named, "fingerprint").select("id", "fingerprint", "root", "component")


def set_key(size: int) -> Callable[[Column], Column]:
    """Text column -> hash of its set of `size`-word shingles; that of the empty set for null."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_set_hash(np.unique(shingle_hashes((t or "").encode(), size))) for t in texts], dtype=object)

    return of


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, **how) -> DataFrame:
    """The rows of `documents` without near copies: of each class the row with the smallest id stays.

    `how` goes to similar_classes. Rows without id stay. Where several rows have that id, the one with the least
    hash of its shingle set stays, and of equal sets that with the least text, of equal texts any one. Only rows of
    such ids are told apart by their texts; all others by their ids alone.
    """
    found = _similar(documents, id_col, text_col, size, **how).where("id IS NOT NULL")
    found = found.select("id", F.substring("fingerprint", -(SET_BITS // 8), SET_BITS // 8).alias("key"), "root", "component")
    keepers = found.where("id = component").groupBy("root", "id").agg(F.min("key").alias("key"))
    repeated = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keepers = graph.cut(keepers.join(repeated, "id", "left").select("id", "key", F.col("n").isNotNull().alias("several")))
    rows = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.join(keepers.where("NOT several"), "id", "left_semi").select("row").unionByName(rows.where("id IS NULL").select("row"))
    if not keepers.where("several").isEmpty():
        mine = rows.join(keepers.where("several").select("id").distinct(), "id", "left_semi").select("row", "id", "text", set_key(size)(F.col("text")).alias("key"))
        mine = mine.join(keepers.where("several").select("id", "key"), ["id", "key"], "left_semi")
        out = out.unionByName(mine.groupBy("id", "key").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row"))
    return out.select("row.*")
