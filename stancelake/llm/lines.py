"""Lines that very many documents repeat, by levelled sorted runs of line hashes.

A run is a Parquet table of (hash, docs), bucketed and sorted by hash, one file a bucket; it covers some consecutive
batches of documents. A new batch counts the documents of each of its line keys, merge-anti-joins the runs (a key that
one of them knows to be frequent needs no more counting) and adds the rest as a run of its own. Where a level has
`width` runs they are compacted to one of the next level, so that n batches leave about width * log(n) runs. Runs
have the same buckets, so that joins between them and sums over them move no rows.

A run's name says which batches it covers. A run that lies within another, or that was not finished, does not count:
a compaction or a batch that is lost half-way changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import graph, text

#: Frequent keys that are sent to all tasks (16 bytes each); more are joined.
MOST_SENT = 1 << 20

HASH = pa.binary(16)


def keys(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and of each its key: without white space `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    lines = raw.split(b"\n")
    return lines, [line.strip().lower() for line in lines]


def _hashes(found: list[bytes], least_chars: int) -> list[bytes]:
    """128-bit hashes of those keys that have that many code points."""
    if least_chars <= 1:
        return [xxhash.xxh3_128_digest(key) for key in found if key or not least_chars]
    return [xxhash.xxh3_128_digest(key) for key in found if len(key.decode("utf-8", "replace")) >= least_chars]


class Runs:
    """The runs of a folder, which may hold some already.

    least: documents from which a key is frequent. Every row is a document, also where ids repeat. Keys of fewer than
    `least_chars` code points are never counted. The number of buckets is fixed by the first run.
    """

    def __init__(self, spark: SparkSession, folder: str, least: int = 10, least_chars: int = 1, width: int = 4):
        self.spark, self.folder, self.least, self.least_chars, self.width = spark, folder, least, least_chars, width
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, int]] = []
        found = self._finished()
        for first, last, buckets in sorted(found, key=lambda run: (run[0], -run[1])):
            if not self.runs or last > self.runs[-1][1]:
                self.buckets = buckets
                self.runs.append((first, last))
                self._known(first, last)

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _finished(self) -> list[tuple[int, int, int]]:
        at, files = self._files()
        if not files.exists(at):
            return []
        finished = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath() for s in files.listStatus(at)]
        return [tuple(map(int, p.getName().split("-")[1:])) for p in names if p.getName().startswith("run-") and files.exists(finished(p, "_SUCCESS"))]

    def _path(self, first: int, last: int) -> str:
        return f"{self.folder}/run-{first}-{last}-{self.buckets}"

    def _table(self, first: int, last: int) -> str:
        return f"{self.name}_{first}_{last}"

    def _known(self, first: int, last: int) -> None:
        """Tells the catalogue of a run that is there."""
        where = self._path(first, last).replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self._table(first, last)} (hash BINARY, docs BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _read(self, first: int, last: int) -> DataFrame:
        return self.spark.table(self._table(first, last))

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        table = self._table(first, last)
        graph.remove(self.spark, self._path(first, last))  # what an unfinished attempt has left
        rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", self._path(first, last)).saveAsTable(table)

    def _level(self, first: int, last: int) -> int:
        level, size = 0, self.width
        while last - first >= size:
            level, size = level + 1, size * self.width
        return level

    def add(self, batch: DataFrame, text_col: str = "text") -> None:
        """Counts a batch of documents. Null and empty texts are one empty line; an empty batch is a run without rows."""
        own = self._counted(batch.select(F.col(text_col).alias("text")))
        for run in self.runs:
            own = own.join(self._read(*run).where(F.col("docs") >= self.least).select("hash").hint("merge"), "hash", "left_anti")
        at = self.runs[-1][1] if self.runs else 0
        self._write(own, at, at + 1)
        self.runs.append((at, at + 1))
        while len(same := [r for r in self.runs if self._level(*r) == self._level(*self.runs[-1])]) >= self.width:
            self._merge(same)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """(hash, docs) of the keys of `rows`, combined within each slice before the shuffle."""
        least_chars = self.least_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text.steps(batch, "text", 8 * text.STEP_BYTES):
                    found: list[bytes] = []
                    for raw in part.column("text").cast(pa.large_binary()).to_pylist():
                        found.extend(set(_hashes(keys(raw or b"")[1], least_chars)))
                    counts = pa.array(found, HASH).value_counts()
                    yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts")], ["hash", "docs"])

        return rows.mapInArrow(run, "hash binary, docs bigint").groupBy("hash").agg(F.least(F.sum("docs"), F.lit(self.least)).cast("bigint").alias("docs"))

    def _sum(self, runs: list[tuple[int, int]]) -> DataFrame:
        """(hash, docs) of several runs together, bucket by bucket.

        All rows have docs > 0. The filter makes rows of the scans' column batches: Spark 4.1 takes a union of bucketed
        scans to be bucketed as well, but puts their partitions one behind another if they are still column batches.
        """
        rows = self._read(*runs[0]).where("docs > 0")
        for run in runs[1:]:
            rows = rows.unionByName(self._read(*run).where("docs > 0"))
        return rows if len(runs) == 1 else rows.groupBy("hash").agg(F.least(F.sum("docs"), F.lit(self.least)).cast("bigint").alias("docs"))

    def _merge(self, runs: list[tuple[int, int]]) -> None:
        whole = (runs[0][0], runs[-1][1])
        self._write(self._sum(runs), *whole)
        for run in runs:
            self.spark.sql(f"DROP TABLE {self._table(*run)}")
            graph.remove(self.spark, self._path(*run))
        self.runs = [r for r in self.runs if r not in runs] + [whole]

    def compact(self) -> None:
        """All runs as one."""
        if len(self.runs) > 1:
            self._merge(self.runs)

    def frequent(self) -> DataFrame:
        """(hash) of the keys of all batches that at least `least` documents hold."""
        if not self.runs:
            return self.spark.createDataFrame([], "hash binary")
        return self._sum(self.runs).where(F.col("docs") >= self.least).select("hash")

    def close(self, remove: bool = False) -> None:
        """Forgets the tables; `remove` deletes the folder."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(*run)}")
        if remove:
            graph.remove(self.spark, self.folder)


def _cut(part: pa.RecordBatch, dropped: np.ndarray | list[set[bytes]], least_chars: int) -> tuple[list[int], list[int], list[bytes]]:
    """Lines, dropped lines and what is kept of each row. dropped: a sorted array for all rows, or a set for each."""
    n_lines, n_dropped, kept = [], [], []
    for row, raw in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
        lines, found = keys(raw or b"")
        hashes = [xxhash.xxh3_128_digest(key) if len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars) else None for key in found]
        if isinstance(dropped, list):
            hit = [h in dropped[row] for h in hashes]
        else:
            values = np.frombuffer(b"".join(h or bytes(16) for h in hashes), "S16")
            at = np.searchsorted(dropped, values)
            hit = ((dropped[np.minimum(at, len(dropped) - 1)] == values) if len(dropped) else np.zeros(len(values), bool)) & np.array([h is not None for h in hashes])
            hit = hit.tolist()
        n_lines.append(len(lines))
        n_dropped.append(sum(hit))
        kept.append(b"\n".join(line for line, gone in zip(lines, hit) if not gone) if n_dropped[-1] else raw or b"")
    return n_lines, n_dropped, kept


def strip(documents: DataFrame, runs: Runs, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row: its text without the lines whose keys are frequent in `runs`.

    Null and empty texts are one empty line, which stays. Ids may be null or repeat; repeated rows are alike, and each
    has a row. `carry` adds a struct `row` with all columns of `documents`, whatever their names. An empty table gives no
    rows. Up to `most_sent` frequent keys go to all tasks and no text is shuffled. More are joined with the hashes of
    each text, and the texts with what they lose. The runs are not read after this returns.
    """
    name = text.free_name(["n_lines", "n_dropped", "kept", "row"], id_col)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    frequent, least_chars = runs.frequent(), runs.least_chars
    few = frequent.limit(most_sent + 1).toArrow().column("hash")
    if len(few) <= most_sent:
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(few.to_pylist()), "S16")))
        gone = lambda part: sent.value
    else:
        key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text.steps(batch, "text"):
                    found = [list(set(_hashes(keys(raw or b"")[1], least_chars))) for raw in part.column("text").cast(pa.large_binary()).to_pylist()]
                    of = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(of)), pa.array([h for x in found for h in x], pa.binary())], ["key", "hash"])

        pairs = rows.select(key.alias("key"), "text").mapInArrow(hashed, "key binary, hash binary")
        lost = graph.cut(pairs.join(frequent.hint("merge"), "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("lost")))
        rows = rows.withColumn("key", key).join(lost, "key", "left").drop("key")
        gone = lambda part: [set(x or ()) for x in part.column("lost").to_pylist()]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"n_lines": "bigint", "n_dropped": "bigint", "kept": "string"}
    order = ["id", "n_lines", "n_dropped", "kept", *(["row"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, "text"):
                n_lines, n_dropped, kept = _cut(part, gone(part), least_chars)
                new = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in order], order)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in order)).withColumnRenamed("id", name)
