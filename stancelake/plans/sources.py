"""Queries that read archives, feeds, sitemaps, labelled sets and detail pages written from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.functions import rules
from stancelake.operators import ingest, snapshots
from stancelake.plans.registry import register
from stancelake.session import new_folder, table, texts
from stancelake.sources import archive, arrivals, pages

NEEDLES = (("northern bank", "north"), ("bank of the south", "south"), ("union bank", "union"))

# who speaks where: a clause of role and institution behind the name, then the venue
_WHO = {0: "Governor of the Bank of the South", 1: "Member of the Board of the Union Bank", 2: "Deputy Governor of the Northern Bank", 3: "Professor of Economics"}


def _described(doc_id: Column) -> Column:
    clause = F.element_at(F.create_map(*[F.lit(x) for pair in _WHO.items() for x in pair]), (doc_id % 4).cast("int"))
    return F.when(doc_id % 9 == 0, F.lit("Panel at the Northern Bank")).otherwise(F.concat(F.lit("Speech by Speaker "), doc_id.cast("string"), F.lit(", "), clause, F.lit(", at the Northern Bank, 1 May")))


_DESCRIBED_SQL = "CASE WHEN doc_id % 9 = 0 THEN 'Panel at the Northern Bank' ELSE 'Speech by Speaker ' || doc_id || ', ' || CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _WHO.items()) + " END || ', at the Northern Bank, 1 May' END"
_CLAUSE_SQL = r"regexp_extract({d}, ',\s*([A-Z][^,]*?\bof\b[^,]*?),', 1)"
_BANK_SQL = "CASE " + " ".join(f"WHEN contains(lower({{c}}), '{needle}') THEN '{bank}'" for needle, bank in NEEDLES) + " END"
_ROLE_SQL = r"CASE WHEN regexp_extract({d}, ',\s*([A-Z][^,]*?)\s+of\s+', 1) = '' THEN 'Central banker' ELSE trim(regexp_extract({d}, ',\s*([A-Z][^,]*?)\s+of\s+', 1)) END"
_MAPPED_SQL = f"m AS (SELECT doc_id, text, d, {_BANK_SQL.format(c='c')} AS bank, {_ROLE_SQL.format(d='d')} AS role FROM (SELECT *, CASE WHEN {_CLAUSE_SQL.format(d='d')} = '' THEN d ELSE {_CLAUSE_SQL.format(d='d')} END AS c FROM (SELECT doc_id, text, {_DESCRIBED_SQL} AS d FROM documents)))"


@register("institution_map", f"WITH {_MAPPED_SQL} SELECT doc_id AS id, bank, role FROM m")
def institution_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank and role from a description of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _described(F.col("doc_id")).alias("description"))
    return rows.select(F.col("doc_id").alias("id"), pages.institution(pages.affiliation(F.col("description")), NEEDLES).alias("bank"), pages.role(F.col("description")).alias("role"))


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a table of ZIP archives of 200 documents each, made by tasks."""
    rows = texts(spark, sf_dir, "doc_id", "text")
    doc_id = F.col("doc_id")
    fields = {
        "date": F.when(doc_id % 13 == 0, "some day").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 300).cast("int")).cast("string")),
        "author": F.concat(F.lit("Speaker "), doc_id.cast("string")), "title": F.concat(F.lit("Speech "), doc_id.cast("string")), "text": F.col("text"),
        "url": F.concat(F.lit("https://example.org/"), doc_id.cast("string")), "description": _described(doc_id),
    }
    folder = new_folder(spark, "archives")
    arrivals.packed(rows, F.concat(F.lit("speeches-"), F.floor(doc_id / 200).cast("string"), F.lit(".zip")), fields).write.parquet(f"{folder}/in")
    return folder


_RECORDS_SQL = f"""WITH {_MAPPED_SQL}, b AS (SELECT *, trim(coalesce(text, ''), ' ') AS body FROM m),
r AS (SELECT *, CASE WHEN bank IS NULL THEN 'untracked' WHEN body = '' THEN 'incomplete' WHEN doc_id % 13 = 0 THEN 'bad date' END AS reason FROM b)"""


@register("archive_stream", _RECORDS_SQL + " SELECT 'https://example.org/' || doc_id AS url, bank, role, sha256(body) AS body_sha256, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR) AS delivered FROM r WHERE reason IS NULL")
def archive_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches of archives that a stream has read; it is polled again, which adds nothing."""
    folder = _archives(spark, sf_dir)
    tables = snapshots.Tables(spark, f"{folder}/store")

    def add(batch: DataFrame, number: int) -> None:
        good, _ = archive.records(batch, NEEDLES)
        if f"epoch-{number}" not in tables.snapshot().batches():
            tables.publish({"speech": good}, f"epoch-{number}")

    for _ in range(2):
        files = spark.readStream.schema("path string, content binary").parquet(f"{folder}/in")
        arrivals.unpacked(files).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tables.read("speech").select("url", "bank", "role", F.sha2("body", 256).alias("body_sha256"), F.date_format("delivered_at", "yyyy-MM-dd").alias("delivered"))


@register("archive_rejects", _RECORDS_SQL + " SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def archive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows of all archives are left out."""
    rows = arrivals.unpacked(spark.read.parquet(f"{_archives(spark, sf_dir)}/in"))
    _, bad = archive.records(rows, NEEDLES)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _lines(rows: DataFrame, line: Column, spark: SparkSession, name: str) -> str:
    folder = new_folder(spark, name)
    rows.select(line.alias("value")).write.text(folder)
    return folder


@register("feed_stream", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/about/' ELSE 'https://example.org/' END || doc_id AS url, 'Speech ' || doc_id || ' & more' AS title, 'Speaker ' || source AS speaker FROM documents WHERE doc_id % 7 <> 0")
def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds that a stream has read; those without a speaker are left out."""
    i = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 5 == 0, F.lit("<link> </link>")).otherwise(F.concat(F.lit("<link>https://example.org/"), i, F.lit("</link>")))
    speaker = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<dc:creator> Speaker "), F.col("source"), F.lit("</dc:creator>")))
    item = F.concat(F.lit('<item rdf:about="https://example.org/about/'), i, F.lit('"><title>Speech '), i, F.lit(" &amp; more</title>"), link, speaker, F.lit("<dc:date>2024-01-01</dc:date></item>"))
    root = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    feeds = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 500).alias("feed"), item.alias("item")).groupBy("feed").agg(F.concat(F.lit(root), F.array_join(F.collect_list("item"), ""), F.lit("</rdf:RDF>")).alias("value"))
    folder = new_folder(spark, "feed")
    feeds.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    store = new_folder(spark, "feed")
    query = arrivals.feed_items(spark, folder, stream=True).writeStream.option("checkpointLocation", f"{store}/checkpoint").option("path", f"{store}/items").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{store}/items").select("url", "title", "speaker")


@register("sitemap_scan", r"""SELECT DISTINCT url, strptime(regexp_extract(url, '/(\d{8})', 1), '%Y%m%d')::DATE AS date FROM (SELECT 'https://example.org/' || strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y%m%d') || chr(CAST(97 + doc_id % 3 AS INTEGER)) || '.htm' AS url, doc_id FROM documents WHERE doc_id % 11 <> 0) WHERE doc_id % 300 >= 121""")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated locations from May on, each once; the others name no day."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyyMMdd")
    name = F.when(F.col("doc_id") % 11 == 0, F.lit("about")).otherwise(F.concat(day, F.char(97 + F.col("doc_id") % 3)))
    line = F.concat(F.lit("<url><loc> https://example.org/"), name, F.lit(".htm</loc></url>"))
    return archive.read_sitemap(spark, _lines(table(spark, sf_dir, "documents").select("doc_id"), line, spark, "sitemap"), since="2024-05-01")


_LABELLED = {0: "dovish", 1: "hawkish", 2: "neutral"}


@register("labelled_scan", "SELECT 'Sentence ' || doc_id AS text, ['dovish', 'hawkish', 'neutral'][quality + 2 * toxic + 1] AS label FROM labels WHERE quality + 2 * toxic < 3")
def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set of JSON lines."""
    folder = new_folder(spark, "labelled")
    rows = table(spark, sf_dir, "labels")
    rows.select(F.concat(F.lit("Sentence "), F.col("doc_id").cast("string")).alias("sentence"), (F.col("quality") + 2 * F.col("toxic")).alias("label")).write.json(folder)
    return archive.read_labelled(spark, folder, _LABELLED)


@register("labelled_csv_scan", """SELECT 'We, "Sentence" ' || doc_id AS text, CASE quality WHEN 1 THEN 'hawkish' ELSE 'dovish' END AS label FROM labels WHERE toxic = 0""")
def labelled_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second labelled set, of CSV with quotes and named labels."""
    folder = new_folder(spark, "labelled")
    label = F.when(F.col("toxic") == 1, "no label").when(F.col("quality") == 1, " Entailment").otherwise("CONTRADICTION")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit(' We, "Sentence" '), F.col("doc_id").cast("string")).alias("sentence"), label.alias("4_stance_nli"))
    rows.write.csv(folder, header=True, quote='"', escape='"', quoteAll=True)
    return archive.read_labelled_csv(spark, folder)


@register("detail_pages", r"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') END AS body, CASE WHEN doc_id % 10 <> 0 AND doc_id % 3 = 0 THEN '/files/' || doc_id || '.PDF' END AS pdf
FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[<>&]')""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and PDF path from the JSON in detail pages made of the documents that have no markup of their own."""
    rows = texts(spark, sf_dir, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).where("NOT text RLIKE '[<>&]'")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit(".PDF"))).otherwise("/files/page.html")
    props = F.to_json(F.struct(F.lit(1).alias("first"), F.struct(path.alias("path"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("content")).alias("document")))
    escaped = F.replace(F.replace(props, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    held = F.when(F.col("doc_id") % 10 == 0, F.lit("{&quot;document&quot;: cut")).otherwise(escaped)
    html = F.concat(F.lit('<html><body><div id="a"></div><div class="x" data-react-props="'), held, F.lit('"></div><div data-react-props="{}"></div></body></html>'))
    return rows.select("doc_id", pages.detail(html).alias("d")).select("doc_id", "d.body", "d.pdf")


_TONE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'hawkish' WHEN 'O' THEN 'dovish' ELSE 'unsure' END"
_RULES_SQL = "[CASE WHEN o_custkey % 50 = 0 THEN 'speaker_id' END, CASE WHEN {t} = 'unsure' THEN 'tone' END, CASE WHEN NOT (o_totalprice / 250000.0 - 1.0) BETWEEN -1 AND 1 THEN 'score' END, CASE WHEN o_orderkey % 40 = 0 THEN 'source_sha256' END]"


@register("observation_rules", f"SELECT id, reasons FROM (SELECT o_orderkey AS id, array_to_string(list_sort(list_filter({_RULES_SQL.format(t=_TONE_SQL)}, lambda x: x IS NOT NULL)), ',') AS reasons FROM orders) WHERE reasons <> ''")
def observation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that break a rule of the domain, and which."""
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("speaker_id"), F.col("o_orderdate").alias("observed_at"),
        F.when(F.col("o_orderstatus") == "F", "hawkish").when(F.col("o_orderstatus") == "O", "dovish").otherwise("unsure").alias("tone"), (F.col("o_totalprice") / 250000.0 - 1.0).alias("score"),
        F.when(F.col("o_orderkey") % 40 == 0, F.upper(F.concat(digest, F.lit("F")))).otherwise(digest).alias("source_sha256"), F.lit(0.0).alias("lexicon_score"), F.lit(False).alias("needs_review"),
    )
    _, rejected = ingest.validated(rows, rules.observation())
    return rejected.select("id", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))
