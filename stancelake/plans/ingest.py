"""Queries over ingestion: de-duplication, anti joins, keys, validation, page fields, institutions, the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import ingest
from stancelake.plans.registry import register
from stancelake.plans.roles import rounded
from stancelake.session import new_folder, table, texts
from stancelake.sources import pages
from stancelake.streaming import standing, stateful


@register("dedupe_by_hash", "SELECT min(doc_id) AS doc_id, sha256(text) AS source_sha256 FROM documents GROUP BY text")
def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_of_text(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "source_sha256")


@register("ingest_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unseen(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@register("stored_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def stored_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.known(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@register("ensure_speakers", "SELECT sha256(source || chr(31) || lang) AS id, source, lang FROM (SELECT DISTINCT source, lang FROM documents) WHERE lang <> 'en' UNION ALL SELECT 'stored', source, lang FROM (SELECT DISTINCT source, lang FROM documents) WHERE lang = 'en'")
def ensure_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang")
    stored = rows.where("lang = 'en'").distinct().select(F.lit("stored").alias("id"), "source", "lang")
    return ingest.ensure(rows, stored, ["source", "lang"])


@register("upsert_stance", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality + 10 ELSE quality END AS rate_path FROM labels")
def upsert_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rate_path"))
    return ingest.upsert(stored, stored.where("doc_id % 3 = 0").withColumn("rate_path", F.col("rate_path") + 10), "doc_id")


@register("validation_rejects", """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 400000) THEN 'price' END, CASE WHEN NOT (length(o_orderpriority) BETWEEN 1 AND 8) THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 400000) OR NOT (length(o_orderpriority) BETWEEN 1 AND 8)""")
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"price": F.col("o_totalprice").between(1000, 400000), "priority": F.char_length("o_orderpriority").between(1, 8)}
    _, rejected = ingest.validated(table(spark, sf_dir, "orders"), rules)
    return rejected.select(F.col("o_orderkey").alias("id"), F.array_join("reasons", ",").alias("reasons"))


@register("pending_rescore", "SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def pending_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("bank"))
    return ingest.pending(rows, table(spark, sf_dir, "labels"), "doc_id", "fr", 25).select("doc_id")


@register("page_fields", r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN url LIKE 'http%' THEN url ELSE 'https://example.org' || url END AS url,
  regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(t) AS chars, sha256(t) AS text_sha256, len(regexp_extract_all(t, '[^ ]+')) >= 50 AS long_enough FROM
  (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "page_id", "url", "html", name="pages").withColumn("t", pages.html_text(F.col("html")))
    return rows.select("page_id", pages.host(F.col("url")).alias("host"), pages.absolute(F.col("url"), "https://example.org").alias("url"), pages.title(F.col("html")).alias("title"), F.char_length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("text_sha256"), pages.long_enough(F.col("t")).alias("long_enough"))


_STREAM_SQL = "SELECT user_id AS member, round(arg_max(value, (ts, event_id)), 9) AS score, count(*) AS readings FROM events GROUP BY user_id"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of readings."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events*.parquet")
    return rows.select(F.col("user_id").alias("member"), "ts", F.col("event_id").alias("id"), F.col("value").alias("score"))


@register("stream_standing", _STREAM_SQL)
def stream_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing of every user after a stream over the events has ended."""
    folder = new_folder(spark, "standing")
    standing.stream_table(standing.standing(_readings(spark, sf_dir)), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return standing.stream_result(spark, f"{folder}/table").select("member", *rounded("score"), "readings")


@register("stream_changes", "SELECT user_id AS member, round(arg_max(value, (ts, event_id)), 9) AS score, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS id, count(*) AS readings FROM events GROUP BY user_id")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from keyed state, whose changes are added to a table batch by batch."""
    session = spark.newSession()  # settings of its own
    for name, value in stateful.STORE.items():
        session.conf.set(name, value)
    folder = new_folder(spark, "changes")
    # the events are of a month, and files may come in any order
    found = stateful.changes(_readings(session, sf_dir), late="40 days")
    stateful.keep(found, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return stateful.standings(spark, f"{folder}/table").select("member", *rounded("score"), "ts", "id", "readings")
