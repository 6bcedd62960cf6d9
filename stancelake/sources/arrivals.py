"""Archives and feeds as they arrive: read as whole files by Spark's own readers, from any file system, once each.

A stream over a folder keeps what it has read in its checkpoint, so that polling again gives no rows and a restart goes on
where it was. What is read is decided before a file is opened: by folders such as `period=2024-05`, by the time of
change, and by name. A file that cannot be read is a row with a problem and never stops a stream.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.sources import archive

#: What Spark's reader of whole files gives.
FILES = "path string, modificationTime timestamp, length bigint, content binary"

ROWS = "path string, ordinal bigint, " + ", ".join(f"{f} string" for f in archive.FIELDS) + ", problem string"

#: Rows of an archive that a task makes at once.
TOGETHER = 256


def whole_files(spark: SparkSession, path: str, stream: bool = False, since: str | None = None, names: str | None = None, per_batch: int | None = None, partitions: str = "") -> DataFrame:
    """path, modificationTime, length, content of the files under a folder, and its partition columns.

    since: only files changed at or after this time; names: a pattern of file names; both are looked at before content
    is read. `partitions` names the columns of folders ("period string") for a stream, which must know them before.
    per_batch: files of a micro-batch at most. A file may have 2 GB.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile")
    if stream:
        reader = reader.schema(FILES + (f", {partitions}" if partitions else ""))
        if per_batch:
            reader = reader.option("maxFilesPerTrigger", per_batch)
    if names:
        reader = reader.option("pathGlobFilter", names)
    rows = reader.load(path)
    return rows if since is None else rows.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))


def _rows_of(path: str, content: bytes, csv_name: str | None) -> Iterator[tuple]:
    """(ordinal, fields) of the one CSV of a ZIP; ValueError if there is not one, or it lacks columns."""
    with zipfile.ZipFile(io.BytesIO(content)) as opened:
        with opened.open(archive.member_of(path, opened.namelist(), csv_name)) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
            at = archive.places(path, next(rows, []))
            for n, row in enumerate(rows):
                yield (n, *(row[at[f]] if at[f] < len(row) else None for f in archive.FIELDS))


def unpacked(files: DataFrame, csv_name: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all archives (path, content), of a table or a stream: path, ordinal, the six fields, problem, and `keep`.

    The CSV is unpacked as a stream, some rows at a time; an archive is one task's. One that is no ZIP, is cut short, has no
    CSV or several, or lacks a column is one row with a problem, behind the rows that were read before it. A null content
    is a problem too; an archive of no rows gives none. Archives that are equal are read each.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                waiting: list[tuple] = []

                def made() -> pa.RecordBatch:
                    columns = [pa.array(c, pa.int64() if name == "ordinal" else pa.string()) for name, c in zip(names, zip(*waiting))]
                    again = [batch.column(c).take(pa.array([i] * len(waiting))) for c in keep]
                    return pa.RecordBatch.from_arrays([*columns, *again], [*names, *keep])

                try:
                    for row in _rows_of(path or "", content or b"", csv_name):
                        waiting.append((path, *row, None))
                        if len(waiting) >= TOGETHER:
                            yield made()
                            waiting.clear()
                except (ValueError, KeyError, EOFError, csv.Error, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as error:
                    waiting.append((path, None, *[None] * len(archive.FIELDS), f"{type(error).__name__}: {error}"))
                if waiting:
                    yield made()

    return files.select("path", "content", *keep).mapInArrow(run, ", ".join([ROWS, *kept]))


def archives(spark: SparkSession, path: str, csv_name: str | None = None, keep: tuple[str, ...] = (), **how) -> DataFrame:
    """unpacked() of the files that whole_files() finds."""
    return unpacked(whole_files(spark, path, **how), csv_name, keep)


def feed_items(spark: SparkSession, path: str, stream: bool = False, per_batch: int | None = None) -> DataFrame:
    """archive.feed_fields() of the items of all feeds under a path, or of a stream of them."""
    reader = spark.readStream if stream else spark.read
    if stream and per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return archive.feed_fields(reader.format("xml").option("rowTag", "item").schema(archive.ITEM).load(path))


def packed(rows: DataFrame, group: Column, fields: dict[str, Column]) -> DataFrame:
    """(path, content): a ZIP with one CSV of the six fields for each `group`, whose name it has. For exports and tests.

    The rows of a group are written as they come, so a group is what one archive should hold.
    """
    chosen = rows.select(group.cast("string").alias("path"), *[fields[f].cast("string").alias(f) for f in archive.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None

        def opened() -> None:
            nonlocal buffer, zipped, writer
            buffer = io.BytesIO()
            zipped = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
            member = io.TextIOWrapper(zipped.open("speeches.csv", "w", force_zip64=True), "utf-8", newline="")
            writer = (member, csv.writer(member))
            writer[1].writerow(archive.FIELDS)

        def closed() -> pa.RecordBatch:
            writer[0].close()
            zipped.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([buffer.getvalue()], pa.binary())], ["path", "content"])

        buffer = zipped = writer = None
        for batch in batches:
            for path, *row in zip(*(batch.column(c).to_pylist() for c in ("path", *archive.FIELDS))):
                if path != name:
                    if writer:
                        yield closed()
                    name = path
                    opened()
                writer[1].writerow(["" if x is None else x for x in row])
        if writer:
            yield closed()

    return chosen.repartition("path").sortWithinPartitions("path").mapInArrow(run, "path string, content binary")
