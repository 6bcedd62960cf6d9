"""Archives and feeds as files of any store: streams that go on where they were, pruned folders, bad files; rules and detail pages."""

import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stancelake.functions import rules
from stancelake.operators import ingest
from stancelake.sources import archive, arrivals, pages

HEADER = "Date,Author,Title,Text,URL,Description\n"


def zipped(*members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return buffer.getvalue()


def row(n, text="words"):
    return f'2024-01-0{n},A,T,"{text}",http://x/{n},"Talk by A, Governor of the Union Bank, here"\n'


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


def test_bad_archives_are_rows_with_a_problem(spark):
    long = 'a ""quoted"" line\n' * 20_000
    whole = zipped(("s.csv", "﻿" + HEADER + row(1) + row(2, long)))
    files = [("good", whole), ("again", whole), ("none", None), ("junk", b"PK no zip"), ("cut", whole[: len(whole) // 2]), ("empty", zipped()), ("two", zipped(("a.csv", HEADER), ("b.CSV", HEADER))), ("columns", zipped(("a.csv", "Date,Author\n"))), ("no rows", zipped(("a.csv", HEADER)))]
    rows = spark.createDataFrame(files, "path string, content binary")
    got = arrivals.unpacked(rows).collect()
    problems = {r["path"]: r["problem"] for r in got if r["problem"]}
    assert set(problems) == {"none", "junk", "cut", "empty", "two", "columns"}
    assert "missing columns" in problems["columns"] and "one CSV is needed" in problems["two"]
    good = {(r["path"], r["ordinal"]): r["text"] for r in got if not r["problem"]}
    assert set(good) == {(p, n) for p in ("good", "again") for n in (0, 1)} and good["good", 1] == long.replace('""', '"')
    named = arrivals.unpacked(rows.where("path = 'two'"), csv_name="a.csv")
    assert named.count() == 0 and arrivals.unpacked(rows.limit(0)).count() == 0


def test_what_is_packed_is_unpacked(spark):
    texts = [None, "", ' "q", \n and\r\nmore ', "é日本", "x" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    fields = {f: F.lit(f) for f in archive.FIELDS} | {"text": F.col("t"), "url": F.col("k").cast("string")}
    files = arrivals.packed(rows.repartition(3), F.col("k") % 2, fields)
    assert {r["path"] for r in files.collect()} == {"0", "1"}
    got = {int(r["url"]): r["text"] for r in arrivals.unpacked(files).collect()}
    assert got == {k: t or "" for k, t in enumerate(texts)}


def read_all(spark, source, tmp_path, **how):
    rows = arrivals.archives(spark, str(source), stream=True, **how)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["url"])


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.zip", zipped(("s.csv", HEADER + row(1) + row(2))))
    put(source, "b.zip", b"not a zip")
    put(source, "readme.txt", b"other")
    how = {"names": "*.zip", "per_batch": 1}
    assert read_all(spark, source, tmp_path, **how) == ["http://x/1", "http://x/2"]
    assert read_all(spark, source, tmp_path, **how) == ["http://x/1", "http://x/2"]  # polled again
    put(source, "c.zip", zipped(("s.csv", HEADER + row(3))))
    assert read_all(spark, source, tmp_path, **how) == ["http://x/1", "http://x/2", "http://x/3"]
    assert spark.read.parquet(str(tmp_path / "out")).where("problem IS NOT NULL").count() == 1


def test_what_is_not_asked_for_is_not_read(spark, tmp_path):
    source = tmp_path / "in"
    put(source / "period=2024-01", "a.zip", zipped(("s.csv", HEADER + row(1))))
    put(source / "period=2024-02", "b.zip", zipped(("s.csv", HEADER + row(2))))
    rows = arrivals.archives(spark, str(source), keep=("period",)).where("period = '2024-02'")
    files = arrivals.whole_files(spark, str(source)).where("period = '2024-02'")
    assert "PartitionFilters: [isnotnull(period" in files._jdf.queryExecution().executedPlan().toString()
    assert [(r["url"], str(r["period"])) for r in rows.collect()] == [("http://x/2", "2024-02")]
    old = datetime.datetime(2020, 1, 1).timestamp()
    os.utime(source / "period=2024-01" / "a.zip", (old, old))
    late = arrivals.whole_files(spark, str(source), since="2021-01-01")
    assert "PushedFilters: [IsNotNull(modificationTime), GreaterThanOrEqual(modificationTime" in late._jdf.queryExecution().executedPlan().toString()
    os.chmod(source / "period=2024-01" / "a.zip", 0)
    assert [r["length"] > 0 for r in late.collect()] == [True]
    streamed = arrivals.archives(spark, str(source), stream=True, partitions="period string", keep=("period",), since="2021-01-01")
    assert streamed.isStreaming and streamed.columns[-1] == "period"


def test_feeds_as_a_stream(spark, tmp_path):
    item = '<item rdf:about="http://x/{0}"><title>T</title><dc:creator>A</dc:creator><dc:date>2024</dc:date></item>'
    put(tmp_path / "in", "1.xml", f'<rdf:RDF xmlns:rdf="r" xmlns:dc="d">{item.format(1)}{item.format(2)}</rdf:RDF>'.encode())
    def poll():
        rows = arrivals.feed_items(spark, str(tmp_path / "in"), stream=True, per_batch=1)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert poll() == poll() == ["http://x/1", "http://x/2"]


def test_detail_pages(spark):
    def of(props, quote='"'):
        escaped = props.replace("&", "&amp;").replace(quote, "&quot;" if quote == '"' else "&#39;")
        return f"<div id=a></div><div class=b data-react-props={quote}{escaped}{quote}></div><div data-react-props='{{}}'></div>"

    cases = [
        (of('{"document": {"content": "<p>It\'s &amp; a</p> <b>b</b>", "path": "/x/A.PDF"}}'), ("It's & a b", "/x/A.PDF")),
        (of('{"z": [1], "document": {"path": "/x/a.html", "content": "c"}, "a": {"document": 1}}', "'"), ("c", None)),
        (of('{"document": {"path": 3, "content": null}}'), ("", None)),
        (of('{"document": "text"}'), ("", None)),
        (of('{"document": {"content": "a'), ("", None)),
        (of("[1]"), ("", None)),
        ("<p>no props</p>", ("", None)),
        (None, ("", None)),
    ]
    rows = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(cases)], "k int, html string")
    got = {r["k"]: (r["d"]["body"], r["d"]["pdf"]) for r in rows.select("k", pages.detail(F.col("html")).alias("d")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def broken(spark, found, values, defaults):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (defaults | values).items()])
    _, rejected = ingest.validated(row, found)
    return [r["reasons"] for r in rejected.collect()]


def test_rules_of_the_domain(spark):
    moment = datetime.datetime(2024, 1, 1)
    one = {"id": "a", "speaker_id": "b", "observed_at": moment, "tone": "mixed", "score": -1.0, "source_sha256": "0a" * 32, "lexicon_score": 1.0, "needs_review": False}
    rule = rules.observation()
    assert broken(spark, rule, {}, one) == []
    for values, names in (({"score": 1.0001}, ["score"]), ({"score": float("nan")}, ["score"]), ({"source_sha256": "0A" * 32}, ["source_sha256"]), ({"source_sha256": "0a" * 32 + "\n"}, ["source_sha256"]), ({"tone": "Hawkish", "needs_review": None}, ["needs_review", "tone"]), ({"observed_at": None}, ["observed_at"])):
        assert broken(spark, rule, values, one) == [names]
    zone = rules.observation(rules.with_zone("observed_at"))
    for text, good in (("2024-01-01T10:00:00Z", True), ("2024-01-01T10:00:00+02:00", True), ("2024-01-01T10:00:00", False), ("2024-13-01T10:00:00Z", False)):
        assert broken(spark, zone, {"observed_at": text}, one) == ([] if good else [["observed_at"]])
    speaker = {"id": "a", "name": "é" * 200, "central_bank": "north", "role": "R"}
    assert broken(spark, rules.speaker(["north"]), {}, speaker) == []
    assert broken(spark, rules.speaker(["south"]), {"name": "é" * 201, "role": ""}, speaker) == [["name", "central_bank", "role"]]
    speech = one | {"central_bank": "north", "title": "t", "url": "u", "language": "en", "text": "x", "summary": "s", "rationale": "r", "model_id": "m", "delivered_at": moment}
    assert broken(spark, rules.speech(["north"]), {}, speech) == []
    assert broken(spark, rules.speech(["north"]), {"language": "e", "text": "", "title": "t" * 501}, speech) == [["title", "language", "text"]]
