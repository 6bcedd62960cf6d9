"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm import chat, decontaminate, graph, html, licences, mixing_lm, mixture, quality, sampling, simhash, telephony, text, toxicity

LONG = "word " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "one two three four five six seven", "en", None), (3, "one two three four five six seven", "en", None), (4, LONG, "fr", "t"), (None, "no id here", "en", "s"), (5, " \n\t", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("id", F.lit("clash")).withColumn("words", F.lit(7)).withColumn("block", F.lit(1)).withColumn("n_words", F.lit(9)).withColumn("score", F.lit("x"))


def test_word_spans_and_hashes():
    data = np.frombuffer(b"ab cdab", np.uint8)
    starts, ends, rows = text.word_spans(data, np.array([0, 0, 5, 7]), text.NOT_SPACE)
    assert list(zip(starts, ends, rows)) == [(0, 2, 1), (3, 5, 1), (5, 7, 2)]
    h = text.SpanHash(data).of(starts, ends)
    assert h[0] == h[2] != h[1]


def test_quality_scores_all_rows(spark, docs):
    model = quality.train(docs, docs.select(F.col("doc_id").alias("id")).where("id = 3"))
    got = quality.score(docs, model)
    assert got.columns == [*docs.columns, "score_"] and got.where("score = 'x' AND score_ >= 0 AND score_ <= 1").count() == 7
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(np.zeros((0, 4), np.float32), np.zeros((3, 4), np.float32)).prior == 0.5


def test_prior_is_near_the_share():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, (4000, 1)), rng.normal(-2, 1, (1000, 1))
    assert abs(quality.estimate_prior(p[:2000, 0], np.concatenate([p[2000:, 0], n[:, 0]])) - 2 / 3) < 0.06


def test_toxicity_on_few_rows(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([(3, 1), (4, 0)], "id long, label int"))
    assert toxicity.score(docs, model).where("score = 'x' AND score_ >= 0 AND score_ <= 1").count() == 7
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pool_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    tables, ids, of = rng.normal(size=(toxicity.TABLE, 48)).astype(np.float32), rng.integers(0, toxicity.TABLE, (500, 3)), np.sort(rng.integers(0, 9, 500))
    whole = toxicity.pool(tables, np.zeros(24, np.float32), ids, of, 9, True)
    monkeypatch.setattr(toxicity, "PART", 50)
    parts = toxicity.pool(tables, np.zeros(24, np.float32), ids, of, 9, True)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_pool_in_parts_of_one_text_is_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    tables, ids, of = rng.normal(size=(toxicity.TABLE, 48)).astype(np.float32), rng.integers(0, toxicity.TABLE, (500, 3)), np.full(500, 2)
    whole = toxicity.pool(tables, np.zeros(24, np.float32), ids, of, 4, True)
    monkeypatch.setattr(toxicity, "PART", 50)
    parts = toxicity.pool(tables, np.zeros(24, np.float32), ids, of, 4, True)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_toxicity_learns_whole_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda ids, langs, y: sorted(len(x) for x in ids))
    labelled = spark.createDataFrame([(3, 1), (4, 0)], "id long, label int")
    assert toxicity.train(docs, labelled) == [7, 30_000]
    monkeypatch.setattr(toxicity, "MOST_BYTES", 10)
    monkeypatch.setattr(toxicity, "LEAST_EACH", 1)
    many = spark.createDataFrame([(i, i % 2) for i in range(400)], "id long, label int")
    texts = spark.createDataFrame([(i, "one two three") for i in range(400)], "doc_id long, text string")
    few = toxicity.train(texts, many)
    assert len(few) < 400 and set(few) <= {3}


def test_mixture_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 100), ("b", "x", "4", 30)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixture.budgets(leaves, F.lit(200), {"a": 1, "b": 1}, 1).collect()}
    # b is short of 70, which a gets; within a/x source 1 is short, and its sibling 2 gets what it lacks
    assert got == {"1": 10, "2": 75, "3": 85, "4": 30} and sum(got.values()) == 200


def test_mixture_edges(spark, docs):
    got = mixture.mix(docs, F.lit(None), {}, (1, 2), 2)
    rows = got.collect()
    assert len(rows) == 7 and sum(r["taken_tokens"] for r in rows) == sum(r["n_tokens"] for r in rows) // 2
    assert mixture.mix(docs.limit(0), F.lit("d"), {}).count() == 0


def test_codecs_round_trip():
    raw = bytes(range(256)) * 3
    for codec in telephony.CODECS:
        kind, rate, _, samples, _ = telephony.unwrap(telephony.wrap(raw, codec))
        assert kind == codec and rate == 8000 and samples == (2 * len(raw) + 3 if codec == "adpcm" else len(raw))
    assert telephony.MULAW[[0, 128]].tolist() == [-32124, 32124] and telephony.ALAW[[0x55, 0xD5]].tolist() == [-8, 8]
    assert telephony.double_rate(np.array([100, 100, 100], np.int16)).tolist() == [100] * 6
    assert telephony.unwrap(b"RIFFxxxxWAVE") is None and telephony.unwrap(None) is None


def test_adpcm_side_by_side_is_one_by_one():
    rng = np.random.default_rng(4)
    blocks, heads, index = rng.integers(0, 256, (5, 40), np.uint8), rng.integers(-999, 999, 5), rng.integers(0, 89, 5)
    together = telephony.adpcm_blocks(blocks, heads, index)
    for b in range(5):
        value, at, out = int(heads[b]), int(index[b]), [int(heads[b])]
        for byte in blocks[b].tolist():
            for n in (byte & 15, byte >> 4):
                s = int(telephony.STEPS[at])
                d = (s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1)
                value = max(-32768, min(32767, value - d if n & 8 else value + d))
                at = max(0, min(88, at + int(telephony.CHANGES[n & 7])))
                out.append(value)
        assert together[b].tolist() == out


def test_decode_of_nulls_and_junk(spark):
    rows = spark.createDataFrame([(1, None), (2, b"junk"), (3, telephony.wrap(b"abc", "mulaw"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in telephony.decode(rows).collect()}
    assert got[1]["codec"] is None and got[2]["pcm"] is None and got[3]["payload"] == b"abc" and len(got[3]["pcm"]) == 12


def test_foreign_adpcm_is_decoded_whole(spark):
    import struct

    # two blocks of 12 bytes, headers with samples of their own, the second cut to 7 bytes; no fact chunk
    data = struct.pack("<hBB", 500, 3, 0) + bytes(range(8)) + struct.pack("<hBB", -70, 0, 0) + b"\x11\x22\x33"
    form = struct.pack("<HHIIHHHH", 17, 1, 8000, 4055, 12, 4, 2, 17)
    chunks = b"fmt " + struct.pack("<I", 20) + form + b"data" + struct.pack("<I", len(data)) + data
    media = b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
    rows = spark.createDataFrame([(1, media), (2, media[:-1]), (3, telephony.wrap(b"x" * 700, "adpcm")), (4, telephony.wrap(b"x" * 700, "mulaw")[:-300])], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in telephony.decode(rows).collect()}
    pcm = np.frombuffer(got[1]["pcm"], "<i2")[::2]
    assert len(pcm) == 17 + 7 and pcm[0] == 500 and pcm[17] == -70 and got[1]["payload"] == bytes(range(8)) + b"\x11\x22\x33"
    assert got[2]["codec"] is None and got[2]["pcm"] is None and got[4]["payload"] is None
    assert got[3]["payload"] == b"x" * 700 and len(got[3]["pcm"]) == 4 * (1400 + 3)


def test_pcm_is_stored(spark, tmp_path):
    rows = spark.createDataFrame([(1, telephony.wrap(b"abc", "mulaw")), (2, None), (3, telephony.wrap(b"", "adpcm"))], "doc_id long, media binary")
    stored = telephony.store(telephony.decode(rows), str(tmp_path / "pcm"))
    got = {r["doc_id"]: r for r in stored.collect()}
    assert len(got) == 3 and len(got[1]["pcm"]) == 12 and got[1]["codec"] == "mulaw" and got[2]["pcm"] is None and got[3]["pcm"] == b""
    assert telephony.decode(rows.limit(0)).count() == 0


def test_roles_stay_as_they_are(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, 0, "system", ""), (4, 1, "user", "u"), (5, 0, None, None), (5, None, "bot", "z"), (None, 1, "user", "n"), (6, 0, "system", "alone"), (7, 0, "user", "long " * 200_000)]
    records = chat.gathered(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = {r["conv"]: [tuple(t) for t in r["turns"]] for r in chat.turns_of_json(records, "record").collect()}
    assert got[1] == [("human", "a"), ("gpt", "b")] and got[2] == [("user", "q"), ("assistant", "a")] and got[3] == [("system", "s"), ("user", "u")]
    assert got[4] == [("system", ""), ("user", "u")] and got[5] == [("bot", "z"), ("", "")] and got[None] == [("user", "n")] and got[6] == [("system", "alone")] and len(got[7][0][1]) == 1_000_000
    assert chat.gathered(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0
    assert len({tuple(sorted(__import__("json").loads(r["record"]))) for r in records.collect()}) == 3


def test_budgets_do_not_overflow(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10**14), ("a", "x", "2", 10**14), ("b", "x", "3", 10**14)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixture.budgets(leaves, F.lit(3 * 10**14), {"a": 10_000, "b": 10_000, "a/x": 10_000, "a/x/1": 10_000, "a/x/2": 10_000}, 2).collect()}
    assert sum(got.values()) == 3 * 10**14 and got["3"] == 15 * 10**13


def test_bk_tree_finds_all():
    rng = random.Random(5)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


@pytest.mark.parametrize("blocks,most", [(4, 2048), (4, 8), (6, 2048)])
def test_links_lose_nothing(spark, blocks, most):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    frame = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fingerprint binary")
    roots = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in graph.components(simhash.links(frame, 64, 3, blocks, most=most)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {v: find(v) for v in values if any(find(v) == find(w) for w in values if w != v)} == roots


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_simhash_edges(spark, docs):
    got = simhash.classes(docs).collect()
    assert len(got) == 7
    empty = [r for r in got if int.from_bytes(r["fingerprint"], "big") == 0]
    assert {r["component"] for r in empty} == {1} and len(empty) == 3
    assert simhash.classes(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]


@pytest.mark.parametrize("most", [2048, 2])
def test_similar_classes_are_exact(spark, most):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [str(rng.randrange(10**6)) for _ in range(rng.randrange(60, 200))]
        rows.append((3 * i, " ".join(words)))
        for k in (1, 2):
            copy = list(words)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = "x"
            rows.append((3 * i + k, " ".join(copy)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(3 * (i // 3), i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    got = {r["doc_id"]: r["component"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert got == root


def test_near_copies_are_by_sets_not_by_repeats(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    line, body = some(9), some(300)
    far = [(1, " ".join([line] * 200 + [some(150)])), (2, " ".join([line] * 200 + [some(150)]))]
    near = [(3, " ".join([line] * 2 + [body])), (4, " ".join([line] * 200 + [body]))]
    # pairs of four and five shingles, four of them common
    short = [(10 + 2 * i + k, text[: None if k else text.rindex(" ")]) for i in range(200) for text in [some(9)] for k in (0, 1)]
    got = {r["doc_id"]: r["component"] for r in simhash.similar_classes(spark.createDataFrame(far + near + short, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3} | {i: i - i % 2 for i, _ in short}


@pytest.mark.parametrize("most_nodes", [1 << 20, 10])
def test_decontamination_spans(spark, docs, most_nodes):
    items = spark.createDataFrame([(1, "Two, three FOUR"), (2, "five"), (3, None), (4, ""), (5, "three four five")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, items, width=3, most_nodes=most_nodes, carry=True).collect()}
    assert got[3]["items"] == ["1", "2", "5"] and [(s["begin"], s["end"], s["words"]) for s in got[3]["spans"]] == [(4, 23, 4)]
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and got[4]["n_words"] == 30_000 and got[3]["row"]["n_words"] == 9
    assert decontaminate.scan(docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.scan(docs.limit(0), items, width=3, most_nodes=most_nodes).count() == 0


@pytest.mark.parametrize("most_nodes,together", [(1 << 20, 4096), (200, 7)])
def test_decontamination_in_parts_is_brute_force(spark, monkeypatch, most_nodes, together):
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    rng = random.Random(15)
    some = lambda n: [rng.choice("ab c\u00e9 D e1".split()) for _ in range(n)]
    items = [(i, some(rng.choice([2, 4, 5, 40]))) for i in range(12)]
    texts = [(i, some(rng.randrange(0, 80))) for i in range(40)]
    low = lambda words: tuple(w.lower() for w in words)
    windows = {}
    for i, words in items:
        size = min(4, len(words))
        for at in range(len(words) - size + 1):
            windows.setdefault(low(words[at : at + size]), set()).add(str(i))
    frames = [spark.createDataFrame([(i, "-".join(w)) for i, w in rows], f"{name} int, text string") for rows, name in ((texts, "doc_id"), (items, "item_id"))]
    got = {r["doc_id"]: r for r in decontaminate.scan(*frames, width=4, most_nodes=most_nodes).collect()}
    for i, words in texts:
        hit, having = set(), set()
        for size in (2, 4):
            for at in range(len(words) - size + 1):
                if found := windows.get(low(words[at : at + size])):
                    hit |= set(range(at, at + size))
                    having |= found
        assert {k for s in got[i]["spans"] for k in range(s["first"], s["first"] + s["words"])} == hit and got[i]["items"] == sorted(having)
        assert all(s["words"] == len(words[s["first"] : s["first"] + s["words"]]) and "-".join(words).encode()[s["begin"] : s["end"]].decode() == "-".join(words[s["first"] : s["first"] + s["words"]]) for s in got[i]["spans"])
        assert got[i]["n_words"] == len(words)


def test_benchmark_rows_without_id_mark_words(spark):
    items = spark.createDataFrame([(None, "two three four"), (7, "six seven"), (None, None)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(rows, items, width=3).collect()}
    assert [[(s["first"], s["words"]) for s in got[k]["spans"]] for k in (1, 2)] == [[(1, 3), (5, 2)], [(1, 3)]]
    assert got[1]["items"] == ["7"] and got[2]["items"] == []


def test_licence_rules(spark):
    bsd = [licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    cases = {
        1: ("Hi.\nReleased under the MIT License.\nBye", ["MIT"]), 2: (". ".join(bsd[:3]) + ".", ["BSD-2-Clause"]), 3: (". ".join(bsd) + ".", ["BSD-3-Clause"]),
        4: (". ".join([bsd[1], bsd[0], bsd[2]]), []), 5: (None, []), 6: ("", []), 7: ("prose. Licensed under CC BY-NC 4.0. Licensed under the\nApache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
        8: ("the license is not a known sentence", []),
    }
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "doc_id int, text string")).collect()}
    assert {k: r["licences"] for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert all(any(a in s for a in licences.ANCHORS) for s in licences.SENTENCES.values()) and {i for _, _, r in licences.RULES for i in r} <= set(licences.SENTENCES)


def test_chat_layouts(spark):
    rows = [
        (1, '{"prompt": "p", "completion": "c"}', [("user", "p"), ("assistant", "c")]), (2, '{"instruction": "i", "input": "x", "output": "o"}', [("user", "i\n\nx"), ("assistant", "o")]),
        (3, '{"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "u"}]}', [("system", "s"), ("human", "u")]), (4, '{"conversations": [{"from": "gpt", "value": null}]}', [("assistant", "")]),
        (5, '{"else": 1}', None), (6, "not json", None), (7, None, None), (8, '{"output": "o", "instruction": "i"}', [("user", "i"), ("assistant", "o")]),
    ]
    got = chat.turns_of_json(spark.createDataFrame([r[:2] for r in rows], "k int, raw string"), "raw").collect()
    assert {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in got} == {k: v for k, _, v in rows}


def test_chat_template_reads_back(spark):
    said = ["", "</s>[INST] ok [/INST]", "~1 ~ ~0 <s>", "[ROLE]x[TEXT]", "a\nb", "<</SYS>>"]
    turns = [(role, s) for s in said for role in ("user", "assistant", "system", "tool", "", "[TEXT]~")]
    frame = spark.createDataFrame([(turns,), ([],), (None,)], f"turns {chat.TURNS}")
    got = frame.select("turns", chat.read_back(chat.render(F.col("turns"))).alias("back")).collect()
    assert [(t["role"], t["text"]) for t in got[0]["back"]] == turns and got[1]["back"] == [] and got[2]["back"] is None
    assert all(t["loss"] == (t["role"] == "assistant") for t in got[0]["back"])


def test_html_cases():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("a &lt; b") == "a < b"
    page = "<body><div class='cookie-notice'>We use cookies a lot here</div><div id=main><h2>T</h2><p>One  two.<p>Three <a href=x>four</a> five six seven.</div><div class=comments><p>I say a lot of things at length here</p></div><form>f<input></form></body>"
    assert html.main_text(page) == "T\nOne two.\nThree four five six seven."
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep" and html.main_text("<" * 1000) == "<" * 1000


@pytest.mark.parametrize("inner", ["<article class='post comments-open'>{}</article>", "<div>{}</div>", "<div class=search-result>{}</div>"])
@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "id=pageWithSidebar", "class='related discussion'", ""])
def test_html_wrappers_with_words_of_furniture(wrapper, inner):
    article = "<h2>T</h2>" + "<p>Many words of a long article, which go on for a while here.</p>" * 9
    side = "<div class=sidebar><p>A side note of some length.</p></div><div class='ad'>Buy a thing now.</div>"
    said = "<div class=comments>" + "<p>I have a lot to say about it.</p>" * (40 if "article" in inner else 3) + "</div>"
    page = f"<body><nav>menu</nav><div {wrapper}>{inner.format(article)}{side}{said}</div></body>"
    assert html.main_text(page) == "\n".join(["T"] + ["Many words of a long article, which go on for a while here."] * 9)
    assert html.main_text("<body><nav>x</nav><div class='ad'>Buy a thing now.</div></body>") == ""


def test_html_pages_in_a_form_and_lists_of_sources():
    words = "<p>Many words of a long article, which go on for a while here.</p>" * 9
    said = "\n".join(["Many words of a long article, which go on for a while here."] * 9)
    search = "<form class=q><label>Find things here</label><input></form>"
    for inner in ("<article>{}</article>", "<div>{}</div>"):
        page = f"<body><form id=aspnetForm action='x'><nav>m</nav>{search}{inner.format(words)}<div class=ad>Buy it</div></form></body>"
        assert html.main_text(page) == said
        assert html.main_text(page.replace("id=aspnetForm", "")) == said
    sources = "<ul>" + "".join(f"<li><a href=x{k}>Source {k}</a></li>" for k in range(4)) + "</ul>"
    assert html.main_text(f"<body>{sources.replace('Source', 'Menu')}<article>{words}{sources}</article>{search}</body>") == said + "".join(f"\nSource {k}" for k in range(4))
    assert html.main_text(f"<body><div><p>Words that stay here, several of them.</p></div>{search}</body>") == "Words that stay here, several of them."


def test_html_of_no_rows_and_very_long_pages(spark):
    rows = spark.createDataFrame([(1, "<p>" + "word " * 400_000 + "</p>"), (2, None), (2, None)], "page_id int, html string")
    assert html.extract(rows.limit(0)).count() == 0
    assert sorted(len(r["text"]) for r in html.extract(rows).collect()) == [0, 0, 1_999_999]


def test_chat_records_beyond_what_a_variant_holds(spark):
    long = "say ~<s>[INST] \\ \"it\"\n" * 1_300_000  # 30 MB
    rows = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", long[::-1]), (2, 1, "user", "hi"), (2, 2, "user", None)], "conv_id int, turn int, role string, text string")
    made = chat.turns_of_json(chat.gathered(rows), "record")
    read = made.select("conv", chat.read_back(chat.render(F.col("turns"))).alias("turns"))
    got = {r["conv"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    assert got == {1: [("user", long), ("assistant", long[::-1])], 2: [("user", "hi"), ("user", "")]}


def test_telephony_of_clashing_names_long_media_and_no_rows(spark):
    long = bytes(range(256)) * 20_000  # 5 MB
    rows = spark.createDataFrame([(1, long, "adpcm"), (2, b"", "mulaw"), (3, None, "alaw"), (4, b"ab", "other"), (5, b"xy" * 300, "alaw"), (5, b"xy" * 300, "alaw")], "doc_id int, payload binary, codec string").withColumn("media", F.lit("kept")).withColumn("pcm", F.lit(7))
    made = telephony.encode(rows)
    assert made.columns == ["doc_id", "payload", "codec", "media", "pcm", "media_"]
    back = telephony.decode(made, "media_", keep=("doc_id", "media", "pcm", "codec", "payload"))
    assert back.columns == ["doc_id", "media", "pcm", "codec", "payload", "codec_", "rate", "payload_", "pcm_", "peak", "crossings", "mean_size"]
    got = [(r["doc_id"], r["payload"] and bytes(r["payload"]), r["payload_"] and bytes(r["payload_"]), r["pcm"], r["media"]) for r in back.collect()]
    assert all(r[3:] == (7, "kept") for r in got) and sum(r[0] == 5 for r in got) == 2
    assert all(r[1] == r[2] for r in got if r[0] in (1, 5)) and next(r for r in got if r[0] == 3)[2] is None
    assert telephony.decode(telephony.encode(rows.limit(0)), "media_").count() == 0


def test_licences_of_clashing_names_long_texts_and_no_rows(spark):
    grant = licences.SENTENCES["mit-grant"]
    rows = spark.createDataFrame([(1, "word " * 400_000 + ". " + grant + ". " + "more " * 400_000), (1, None), (None, ""), (2, grant)], "ends int, lines string")
    got = licences.scan(rows, "ends", "lines")
    assert got.columns == ["ends", "sentences", "licences"]
    assert sorted((str(r["ends"]), "mit-grant" in r["sentences"]) for r in got.collect()) == [("1", False), ("1", True), ("2", True), ("None", False)]
    assert licences.scan(rows.withColumnRenamed("ends", "licences"), "licences", "lines").columns == ["licences_", "sentences", "licences"]
    assert licences.scan(rows.limit(0), "ends", "lines").count() == 0


def test_chat_odd_json(spark):
    records = [None, "", "{", '{"prompt": "a\nb", "completion": "c"}', '{"prompt": "a\\nb", "completion": "c"}', '{"pr\\u006fmpt": "a", "completion": "c"}', '{"other": 1}', "[]"]
    rows = spark.createDataFrame([(k, r, "kept") for k, r in enumerate(records)], "k int, record string, turns string")
    made = chat.turns_of_json(rows, "record")
    assert made.columns == ["k", "record", "turns", "turns_"]
    got = {r["k"]: r["turns_"] and [tuple(t) for t in r["turns_"]] for r in made.collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: [("user", "a\nb"), ("assistant", "c")], 5: [("user", "a"), ("assistant", "c")], 6: None, 7: None}
    assert chat.turns_of_json(rows.limit(0), "record").count() == 0


def test_near_copies_of_rows_without_id_link(spark):
    random.seed(2)
    words = [f"w{random.randrange(10**6)}" for _ in range(900)]
    other = [*words[:450], "changed", *words[451:]]
    far = [*other[:440], "again", *other[441:]]
    rows = spark.createDataFrame([(5, " ".join(words)), (None, " ".join(other)), (7, "something else"), (None, "something else")], "doc_id long, text string")
    got = {(r["doc_id"], r["component"]) for r in simhash.similar_classes(rows).collect()}
    assert got == {(5, 5), (None, 5), (7, 7), (None, 7)}
    # a text that only a row without id has is a bridge between two documents
    sets = [set(zip(*[x[k:] for k in range(5)])) for x in (words, far)]
    bridged = rows.unionByName(spark.createDataFrame([(9, " ".join(far))], rows.schema))
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.8
    assert sorted(r["doc_id"] for r in simhash.keep_one(bridged).where("doc_id IS NOT NULL").collect()) == [5, 7]


def test_language_model_edges(spark, docs):
    got = mixing_lm.score(docs, F.col("doc_id") != 4).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["n_tokens"] == by[2]["n_tokens"] == by[5]["n_tokens"] == 1 and by[4]["n_tokens"] == 30_001 and by[4]["n_known"] == 1
    assert mixing_lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert all(r["score"] < 0 for r in mixing_lm.score(docs, F.lit(None).cast("boolean")).collect())


def test_language_model_does_not_depend_on_blocks(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    a, b = ({r["doc_id"]: r for r in mixing_lm.score(rows, F.col("doc_id") % 5 != 0, block_tokens=size, bucket_keys=size).collect()} for size in (1 << 30, 1 << 9))
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert r["n_known"] == b[k]["n_known"] and r["base_score"] == pytest.approx(b[k]["base_score"]) and r["score"] == pytest.approx(b[k]["score"], rel=1e-5)


def test_probabilities_of_a_byte_add_to_one():
    tree = mixing_lm.huffman(np.arange(256))
    assert sum(2.0 ** -(tree.first[b + 1] - tree.first[b]) for b in range(256)) == pytest.approx(1)


def test_passages_are_predicted_from_other_places(spark):
    rng = random.Random(12)
    some = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    twice, held = some(), some()
    rows = spark.createDataFrame([(1, twice), (2, twice), (3, held), (103, held), *((i, some()) for i in range(4, 40))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in mixing_lm.score(rows, F.col("doc_id") < 100).collect()}
    assert max(got[k] for k in range(3, 40)) < 3 * min(got[1], got[2], got[103]) and got[1] == got[2]


def _scored(spark, texts, held):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: r["score"] for r in mixing_lm.score(rows, ~F.col("doc_id").isin(sorted(held))).collect()}


def test_language_model_learns_nothing_from_held_out_texts(spark):
    random.seed(8)
    words = [f"w{random.randrange(500)}" for _ in range(600)]
    passage = lambda: " ".join(words[(at := random.randrange(500)) : at + 60])
    texts = [f"{passage()} {passage()}" for _ in range(40)]
    held = {k for k in range(40) if k % 4 == 1}
    before = _scored(spark, texts, held)
    others = [t if k not in held or k == 1 else " ".join(f"other{random.randrange(10**6)}" for _ in range(3000)) for k, t in enumerate(texts)]
    after = _scored(spark, others, held)
    assert {k: after[k] for k in after if k == 1 or k not in held} == {k: before[k] for k in before if k == 1 or k not in held}


def test_letters_alone_and_with_passages_on_held_out_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = sampling.fold("doc_id", 7) == 2
    spelt = mixing_lm.score(documents, ~held, passages=False).withColumn("held", held).where("held")
    both = mixing_lm.score(documents, ~held).withColumn("held", held).where("held")
    a, b = (f.agg(F.sum("score"), F.sum("base_score"), F.sum("n_coded_bytes")).first() for f in (spelt, both))
    assert a[1] == pytest.approx(b[1]) and b[0] > a[0]
    assert -a[0] / a[2] / math.log10(2) < 3  # bits a byte


def test_a_training_text_is_not_predicted_from_itself(spark):
    random.seed(3)
    of = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    texts = [of(400) for _ in range(12)]
    texts[5] = " ".join([of(60)] * 20)
    got = _scored(spark, texts, set())
    # its letters are known from elsewhere in the text, its passages are not
    parts = mixing_lm.score(spark.createDataFrame([(0, texts[5])], "doc_id int, text string"), F.lit(True)).first()
    assert got[5] / 1200 < -1.0 and parts["score"] < -1200


def test_segments_of_rows():
    data = b"a b c d e f g h i j k l m n o p a b"
    t = mixing_lm.tokens(np.frombuffer(data + data, np.uint8), np.array([0, len(data), 2 * len(data), 2 * len(data)]))
    s = mixing_lm.segments(t)
    assert s.sizes.sum() == len(t.words) == 2 * 19 + 1 and (s.contexts[np.flatnonzero(np.diff(s.rows, prepend=-1))] == 0).all()
    one, two = s.both[s.rows == 0], s.both[s.rows == 1]
    assert (one == two).all() and len(s.both) == 2 * len(one) + 1 and (s.contexts[s.rows == 0][1:] != 0).all()


def test_tables_grow_with_the_lexicon():
    assert mixing_lm.table_sizes(0) == [1 << 14] * 5 and mixing_lm.table_sizes(1 << 40) == [mixing_lm.MOST_SLOTS] * 5
    assert mixing_lm.table_sizes(1 << 20) < mixing_lm.table_sizes(1 << 22)


def test_samples_are_bounded_at_every_size(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), F.lit("t").alias("text"))
    got = [r["id"] for r in sampling.about(rows, ["id", "text"], 500, 3).collect()]
    assert 200 < len(got) <= 500 and got.count(None) <= 1 and len(set(got)) == len(got)
    assert sampling.about(rows, ["id"], 500, 3, known=10**10).count() <= 500
    many = spark.range(10**5).toDF("id")
    assert sampling.about(many, ["id"], 50, 3, known=10**5).count() == 50
    known = sampling.about(rows.limit(5), ["id"], 500, 3)
    assert known.count() == 5


def test_samples_take_one_text_for_each_id(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "id int, text string")
    got = sampling.one_each(rows, "id", "text").collect()
    assert sorted(r["id"] for r in got) == [1, 2] and {r["text"] for r in got} <= {"a", "b", None}


def test_of_rows_with_one_id_one_stays(spark):
    rng = random.Random(13)
    one, two, three = (" ".join(str(rng.randrange(10**6)) for _ in range(50)) for _ in range(3))
    rows = [(1, one, 7), (1, one, 7), (1, two, 7), (2, one + " end", 7), (3, three, 7), (4, "A b", 7), (4, "a  b", 7), (None, one, 7), (None, one, 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component int"))
    got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "component"]
    assert got == sorted([("1", one), ("1", two), ("3", three), ("4", "A b"), ("None", one), ("None", one)])


def _random_page(rng, depth=0):
    """(html, tree): tree is [name, children or text]."""
    kids = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            said = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60)))
            kids[-1:] = [kids[-1] + said] if kids and isinstance(kids[-1], str) else [*kids[-1:], said]
        else:
            kids.append([rng.choice(["div", "b", "a", "section", "i"]), _random_page(rng, depth + 1)])
    return kids


def test_densities_are_those_of_brute_force():
    import math

    def shown(kids):
        return "".join(k if isinstance(k, str) else f"<{k[0]}>{shown(k[1])}</{k[0]}>" for k in kids)

    def facts(node, in_link=False):
        linked = in_link or node[0] == "a"
        total = [0, 0, 0, 0]
        for k in node[1]:
            if isinstance(k, str):
                size = len(" ".join(k.split()))
                total[0] += size
                total[2] += size * linked
            else:
                c, t, lc, lt = facts(k, linked)
                total = [total[0] + c, total[1] + t + 1, total[2] + lc, total[3] + lt + (k[0] == "a")]
        node.append(tuple(total))
        return node[2]

    def density(node, body):
        c, t, lc, lt = node[2]
        if not c:
            return 0.0
        if c == 1:
            return 0.01
        t, lc, lt = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + body[2] / max(1, body[0]) * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base))

    rng = random.Random(14)
    for _ in range(60):
        body = ["body", _random_page(rng)]
        page = f"<body>{shown(body[1])}</body>"
        facts(body)
        in_order, open_ = [], [body]
        while open_:
            node = open_.pop(0)
            in_order.append(node)
            open_ = [k for k in node[1] if not isinstance(k, str)] + open_
        got, sums, at, _ = html._densities(html._parse(page))
        want = [density(x, body[2]) for x in in_order]
        assert got[at:] == pytest.approx(want) and sums[at:] == pytest.approx([sum(density(k, body[2]) for k in x[1] if not isinstance(k, str)) for x in in_order])
        best = max(range(len(in_order)), key=lambda i: (sums[at + i] or got[at + i], -i))
        inside = "".join(x if isinstance(x, str) else shown([x]) for x in in_order[best][1])
        words = "".join(html.main_text(page).split())
        assert "<" in inside or "".join(inside.split()) in words


def test_html_is_parsed_in_linear_time():
    import time

    for page in ("<b>x</i>" * 40_000, "<a'" * 40_000, "<p>" * 40_000, "<!--" * 40_000, "<li>" * 40_000, "</p>" * 40_000, "<div><b>" * 40_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 5


def test_html_tag_names_do_not_select():
    article = "<h1>T</h1>" + "<p>Many words of a long article, which go on for a while here.</p>" * 9
    pages = [f"<body><nav><a href=x>m</a></nav><div class='ad'>Buy.</div><{t}>{article}</{t}><footer>f</footer></body>" for t in ("article", "div", "main", "section")]
    assert len({html.main_text(p) for p in pages}) == 1 and html.main_text(pages[0]).startswith("T\nMany")
    links = "<ul>" + "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(9)) + "</ul>"
    assert html.main_text(f"<body><main>{links}{article}</main></body>") == html.main_text(pages[0])


def test_html_column_names_that_clash(spark):
    got = html.extract(spark.createDataFrame([("<p>a</p>", "mine"), (None, None)], "html string, text string")).collect()
    assert [(r["text"], r["text_"]) for r in got] == [("mine", "a"), (None, "")]


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 64, 3) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [4, 4, 4, 5, 6]
