"""Speech archives: CSV files in ZIPs, RSS feeds, sitemaps, labelled sets."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stancelake import errors
from stancelake.sources import pages

FIELDS = ("date", "author", "title", "text", "url", "description")


def member_of(path: str, names: Sequence[str], csv_name: str | None = None) -> str:
    """The one CSV among an archive's members, or that of a name; ValueError if there is not one."""
    found = [n for n in names if n.lower().endswith(".csv")]
    chosen = [n for n in found if n == csv_name] if csv_name else found
    if len(chosen) != 1:
        raise ValueError(f"{path}: one CSV is needed, there are {found}")
    return chosen[0]


def places(path: str, header: Sequence[str]) -> dict[str, int]:
    """Where each field stands in a header; ValueError if one is missing. Case and white space do not matter."""
    at = {h.strip().lower(): i for i, h in enumerate(header)}
    missing = [f for f in FIELDS if f not in at]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; there are {list(header)}")
    return at


class _Member(InputPartition):
    def __init__(self, path: str, member: str):
        super().__init__(0)
        self.path, self.member = path, member


class _Reader(DataSourceReader):
    """One partition for each archive; the CSV is read as a stream, never whole."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.csv_name = options.get("csv_name")

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            with zipfile.ZipFile(path) as archive:
                member = member_of(path, archive.namelist(), self.csv_name)
                with archive.open(member) as raw:
                    places(path, next(csv.reader(io.TextIOWrapper(raw, "utf-8-sig")), []))
                out.append(_Member(path, member))
        return out

    def read(self, partition: _Member) -> Iterator[tuple]:
        csv.field_size_limit(16 << 20)
        with zipfile.ZipFile(partition.path) as archive, archive.open(partition.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
            at = places(partition.path, next(rows, []))
            for n, row in enumerate(rows):
                yield (n, *(row[at[f]] if at[f] < len(row) else None for f in FIELDS))


class SpeechArchive(DataSource):
    """spark.read.format("speech_archive").option("path", "a.zip,b.zip").load(): ordinal and the six text fields.

    The archive is opened by path on the driver for its header and on the executor that reads it, so it lies in
    a folder that both see. For other stores, streams and archives that may be bad, see arrivals.archives.
    """

    @classmethod
    def name(cls) -> str:
        return "speech_archive"

    def schema(self) -> str:
        return "ordinal bigint, " + ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_archive(spark: SparkSession, *paths: str, csv_name: str | None = None) -> DataFrame:
    spark.dataSource.register(SpeechArchive)
    reader = spark.read.format("speech_archive").option("path", ",".join(paths))
    return (reader.option("csv_name", csv_name) if csv_name else reader).load()


def records(rows: DataFrame, needles: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of archive rows: trimmed fields, bank by the affiliation clause, role, time in UTC.

    Rejected rows have a reason: incomplete, bad date, or untracked.
    """
    trim = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    moment = F.coalesce(*[F.try_to_timestamp(trim("date"), F.lit(p)) for p in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])
    found = rows.select(
        "ordinal", trim("author").alias("speaker"), trim("title").alias("title"), trim("text").alias("body"), trim("url").alias("url"),
        moment.alias("delivered_at"), pages.institution(pages.affiliation(F.col("description")), needles).alias("bank"), pages.role(F.col("description")).alias("role"),
    )
    incomplete = (F.col("speaker") == "") | (F.col("title") == "") | (F.col("body") == "") | (F.col("url") == "")
    reason = F.when(F.col("bank").isNull(), "untracked").when(incomplete, "incomplete").when(F.col("delivered_at").isNull(), "bad date")
    found = found.withColumn("reason", reason)
    return found.where("reason IS NULL").drop("reason"), found.where("reason IS NOT NULL")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """feed_fields() of the feeds at a path."""
    return feed_fields(spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path))


#: An item of an RSS 1.0 feed.
ITEM = "`_rdf:about` string, link string, title string, description string, `dc:creator` string, `dc:date` string"


def feed_fields(raw: DataFrame) -> DataFrame:
    """url, title, speaker, date, description of items with URL, speaker and date; the URL falls back to the item's own name."""
    url = F.coalesce(F.nullif(F.btrim("link"), F.lit("")), F.col("`_rdf:about`"))
    rows = raw.select(url.alias("url"), F.btrim("title").alias("title"), F.btrim("`dc:creator`").alias("speaker"), F.btrim("`dc:date`").alias("date"), "description")
    return rows.where("url IS NOT NULL AND speaker <> '' AND date <> ''")


def read_sitemap(spark: SparkSession, path: str, pattern: str = r"/(\d{4})(\d{2})(\d{2})[^/]*\.html?$", most: int | None = None, since: str | None = None) -> DataFrame:
    """url, date of a sitemap's locations whose URL has a date, from the date `since` on, each once, newest first."""
    whole = spark.read.text(path, wholetext=True)
    urls = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    part = lambda k: F.regexp_extract("url", pattern, k)
    dated = urls.where(F.col("url").rlike(pattern)).select("url", F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date").alias("date"))
    recent = F.lit(True) if since is None else F.col("date") >= F.lit(since).cast("date")
    found = dated.where(F.col("date").isNotNull() & recent).orderBy(F.desc("date"), "url")
    return found if most is None else found.limit(most)


def read_labelled(spark: SparkSession, path: str, labels: dict[int, str], text: str = "sentence", label: str = "label") -> DataFrame:
    """text, label of JSON lines with numbered labels; rows of other numbers are left out."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = spark.read.json(path, schema=f"`{text}` string, `{label}` int")
    return rows.select(F.col(text).alias("text"), F.try_element_at(names, F.col(label)).alias("label")).where("label IS NOT NULL AND text IS NOT NULL")


#: The classes of a set that was labelled by whether a sentence follows from "policy should be tightened".
ENTAILMENT = {"entailment": "hawkish", "contradiction": "dovish", "neutral": "neutral"}


def read_labelled_csv(spark: SparkSession, path: str, text: str = "sentence", label: str = "4_stance_nli", labels: dict[str, str] | None = None) -> DataFrame:
    """text, label of a CSV with named labels, whatever their case; rows of other labels, or without text, are left out."""
    names = F.create_map(*[F.lit(x) for pair in (labels or ENTAILMENT).items() for x in pair])
    rows = _there(lambda: spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'), path)
    found = rows.select(F.btrim(F.col(f"`{text}`")).alias("text"), F.try_element_at(names, F.lower(F.btrim(F.col(f"`{label}`")))).alias("label"))
    return found.where("label IS NOT NULL AND text <> ''")


def _there(read, path: str) -> DataFrame:
    """What `read` gives; a file that is not there is an error of its own."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise errors.BenchmarkUnavailable(path) from error
        raise
