"""Queries of lists and labels: speakers, observations, desks, bars, titles, and which text of a speech is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import boards, ingest, observations, offline, scan
from stancelake.plans.registry import register
from stancelake.plans.roles import OBSERVATIONS_SQL, rounded
from stancelake.plans.roles import observations as readings
from stancelake.session import new_folder, table, texts
from stancelake.sources import pages


@register("speakers_by_name", "SELECT c_custkey AS id, name, row_number() OVER (ORDER BY name, c_custkey) AS place FROM (SELECT c_custkey, reverse(c_name) AS name FROM customer)")
def speakers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All speakers in the order of their names, with the place that each has."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.reverse("c_name").alias("name"))
    return scan.numbered(rows, [], [F.col("name"), F.col("id")])


_TONED_SQL = f"""WITH {OBSERVATIONS_SQL}, t AS (SELECT id, member, ts, score, CASE WHEN score > 0.1 THEN 'hawkish' WHEN score < -0.1 THEN 'dovish' WHEN id % 10 = 3 THEN 'unsure' ELSE 'neutral' END AS tone FROM o WHERE member % 20 <> 1)"""


@register("observations_recorded", _TONED_SQL + " SELECT id, member AS speaker_id, tone, score, sha256(CAST(id AS VARCHAR)) AS source_sha256, row_number() OVER (PARTITION BY member ORDER BY ts, id) AS place FROM t WHERE tone <> 'unsure'")
def observations_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings recorded in two batches, numbered among those of their speaker; unknown speakers and tones are rejected."""
    score = F.col("score")
    tone = F.when(score > 0.1, "hawkish").when(score < -0.1, "dovish").when(F.col("id") % 10 == 3, "unsure").otherwise("neutral")
    rows = readings(spark, sf_dir).select("id", F.col("member").alias("speaker_id"), F.col("ts").alias("observed_at"), tone.alias("tone"), "score", F.col("id").cast("string").alias("source_text"))
    register_ = observations.Register(spark, new_folder(spark, "register"), table(spark, sf_dir, "customer").where("c_custkey % 20 <> 1"), "c_custkey")
    for k in range(2):
        register_.record(rows.where(F.col("id") % 2 == k), f"batch-{k}")
    return register_.numbered().select("id", "speaker_id", "tone", "score", "source_sha256", "place")


@register("desk_labels", """SELECT c_custkey AS id, array_to_string(list_transform(string_split(desk, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label, CASE desk WHEN 'building_desk' THEN 'BLD' WHEN 'machinery_desk' THEN 'MCH' END AS code
FROM (SELECT c_custkey, lower(replace(c_mktsegment, ' ', '_')) || '_desk' AS desk FROM customer)""")
def desk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    desk = F.concat(F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit("_"))), F.lit("_desk"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), boards.desk_label(desk).alias("label"), boards.desk_code(desk, {"building_desk": "BLD", "machinery_desk": "MCH"}).alias("code"))


@register("stance_bars", f"WITH {OBSERVATIONS_SQL}, s AS (SELECT id, floor(score * 100) / 100 AS score FROM o) SELECT id, CASE WHEN score > 0 THEN 'hawk' WHEN score < 0 THEN 'dove' ELSE 'flat' END AS side, round(abs(score) * 50, 1) AS width, CAST(round(score * 100) AS INTEGER) AS percent FROM s")
def stance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).select("id", (F.floor(F.col("score") * 100) / F.lit(100.0)).alias("score"))
    return rows.select("id", *[c.alias(name) for name, c in boards.stance_bar(F.col("score")).items()])


_LEGIBLE_SQL = r"length({0}) > 0 AND NOT contains({0}, '(cid:') AND length(regexp_replace({0}, '[^\p{{L}}\s\x0B]', '', 'g')) > 0.65 * length({0})"
_COUNT_SQL = r"len(regexp_extract_all({0}, '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'))"


@register("full_texts", rf"""WITH p AS (SELECT doc_id, coalesce(text, '') AS page, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || ' and more words' WHEN 1 THEN repeat('(cid:12) ', 2000) WHEN 2 THEN repeat('12 34 ', 5000) ELSE 'a few words' END AS pdf FROM documents),
c AS (SELECT doc_id, CASE WHEN {_LEGIBLE_SQL.format('pdf')} AND {_COUNT_SQL.format('pdf')} > {_COUNT_SQL.format('page')} THEN pdf ELSE page END AS taken, {_LEGIBLE_SQL.format('page')} AS legible FROM p)
SELECT doc_id, sha256(taken) AS sha256, legible, {_COUNT_SQL.format('taken')} >= 50 AS long_enough FROM c""")
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a page's text and that of its PDF is taken: the PDF's where it is legible and longer."""
    page = F.coalesce("text", F.lit(""))
    pdf = F.when(F.col("doc_id") % 4 == 0, F.concat(page, F.lit(" and more words"))).when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("(cid:12) "), 2000)).when(F.col("doc_id") % 4 == 2, F.repeat(F.lit("12 34 "), 5000)).otherwise("a few words")
    taken = texts(spark, sf_dir, "doc_id", "text").select("doc_id", pages.full_text(page, pdf).alias("taken"), pages.is_legible(page).alias("legible"))
    return taken.select("doc_id", F.sha2("taken", 256).alias("sha256"), "legible", pages.long_enough(F.col("taken")).alias("long_enough"))


@register("speech_titles", """WITH h AS (SELECT doc_id, 'Ms Jane Doe' || doc_id AS speaker, CASE doc_id % 4 WHEN 0 THEN 'Jane Doe' || doc_id || ': On rates: a view' WHEN 1 THEN 'Rates: a view' WHEN 2 THEN 'Ms Jane DOE' || doc_id || ':' ELSE ' A plain title ' END AS heading FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'On rates: a view' ELSE trim(heading) END AS title, CASE WHEN starts_with(lower(heading), lower(speaker) || ':') THEN trim(substr(heading, length(speaker) + 2)) ELSE heading END AS shown FROM h""")
def speech_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without the speaker's name, as they are stored and as they are shown."""
    i = F.col("doc_id").cast("string")
    heading = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Jane Doe"), i, F.lit(": On rates: a view"))).when(F.col("doc_id") % 4 == 1, "Rates: a view").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Ms Jane DOE"), i, F.lit(":"))).otherwise(" A plain title ")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Ms Jane Doe"), i).alias("speaker"), heading.alias("heading"))
    return rows.select("doc_id", pages.without_speaker(F.col("heading"), F.col("speaker")).alias("title"), pages.without_name(F.col("heading"), F.col("speaker")).alias("shown"))


@register("first_accepted", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 40")
def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit counts what is accepted, not what is read."""
    accepted = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)
    return ingest.limited(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), accepted, 40, "o_orderkey").select("o_orderkey")


@register("scored_speeches", "SELECT d.doc_id AS speech_id, source, quality - toxic AS rate_path FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def scored_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches that have a stance; the others are left out."""
    stances = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("speech_id"), (F.col("quality") - F.col("toxic")).alias("rate_path"))
    return observations.scored(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("speech_id"), "source"), stances, "speech_id", "rate_path")


@register("offline_model", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM documents), h AS (SELECT doc_id, list_contains(w, 'the')::INT + list_contains(w, 'was')::INT AS h, list_contains(w, 'of')::INT AS d FROM t)
SELECT doc_id, CASE WHEN h > d THEN 'hawkish' WHEN h < d THEN 'dovish' ELSE 'neutral' END AS label, round(coalesce((h - d) / nullif(h + d, 0), 0.0), 9) + 0.0 AS score FROM h""")
def offline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the offline model on whole texts."""
    model = offline.Offline(hawkish=("the", "was"), dovish=("of",))
    found = texts(spark, sf_dir, "doc_id", "text").select("doc_id", model.verdicts(F.array(F.coalesce("text", F.lit(""))))[0].alias("v"))
    return found.select("doc_id", "v.label", F.col("v.score").alias("score")).select("doc_id", "label", *rounded("score"))
