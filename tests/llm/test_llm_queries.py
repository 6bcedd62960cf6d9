"""The queries with SQL give its rows; the others hold against brute force on the smallest tables."""

import collections
import hashlib
import html as entities
import math
import os
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from stancelake.llm import registry

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def texts(spark, sf):
    return {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    frame = registry.queries()[name](spark, sf)
    names = sorted(frame.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = con.sql(registry.oracle_sql()[name])
    order = [result.columns.index(n) for n in names]
    assert sorted(map(str, map(tuple, frame.select(names).collect()))) == sorted(str(tuple(row[i] for i in order)) for row in result.fetchall())


@pytest.mark.parametrize("name,parts,held", [("op1_quality", 3, 1), ("op6_toxicity", 5, 0)])
def test_classifiers_on_held_out_rows(spark, sf, name, parts, held):
    rows = run(spark, sf.replace("0.001", "0.01"), name)
    gold = {r["doc_id"]: r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in gold:
            total += 1
            right += gold[r["doc_id"]]["quality" if "quality" in name else "toxic"] == r["predicted"]
    assert right / total > 0.85


def test_language_model_is_better_than_counts_on_held_out_texts(spark):
    rows = [r for r in run(spark, "/root/testdata/sf0.1", "op2_lm") if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / tokens > sum(r["base_score"] for r in rows) / tokens


def test_language_model_base(spark, sf):
    rows = run(spark, sf, "op2_lm")
    tokens = {i: [*WORD.findall(t.lower()), b"\n"] for i, t in texts(spark, sf).items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_telephony_round_trip(spark, sf):
    raw = texts(spark, sf)
    for r in run(spark, sf, "op4_telephony"):
        b = raw[r["doc_id"]]
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def _media(payload, codec):
    """The file, its samples and the doubled samples, byte by byte."""
    step = "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split()
    pcm, data = [], bytearray()
    if codec == "mulaw":
        for c in payload:
            c = 255 - c
            size = ((2 * (c % 16) + 33) << (c // 16 % 8)) * 4 - 132
            pcm.append(-size if c & 128 else size)
        data += payload
    elif codec == "alaw":
        for c in payload:
            c ^= 0x55
            low, e = c % 16 * 16 + 8, c // 16 % 8
            size = low if e == 0 else (low + 256) * 2 ** (e - 1)
            pcm.append(size if c & 128 else -size)
        data += payload
    else:
        for at in range(0, len(payload), 288):
            block = payload[at : at + 288]
            data += b"\0\0\0\0" + block + b"\0" * (288 - len(block))
            value = index = 0
            pcm.append(0)
            for nibble in [n for c in block for n in (c % 16, c // 16)]:
                s = int(step[index])
                move = s // 8 + (s // 4 if nibble & 1 else 0) + (s // 2 if nibble & 2 else 0) + (s if nibble & 4 else 0)
                value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble % 8]))
                pcm.append(value)
    tag, align, bits = {"mulaw": (7, 1, 8), "alaw": (6, 1, 8), "adpcm": (17, 292, 4)}[codec]
    extra = (2).to_bytes(2, "little") + (577).to_bytes(2, "little") if codec == "adpcm" else b"\0\0"
    second = 8000 * 292 // 577 if codec == "adpcm" else 8000
    form = b"".join(x.to_bytes(n, "little") for x, n in ((tag, 2), (1, 2), (8000, 4), (second, 4), (align, 2), (bits, 2))) + extra
    body = b"".join(name + len(x).to_bytes(4, "little") + bytes(x) + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", form), (b"fact", len(pcm).to_bytes(4, "little")), (b"data", data)))
    at = lambda i: pcm[max(0, min(len(pcm) - 1, i))]
    twice = [y for i, x in enumerate(pcm) for y in (x, max(-32768, min(32767, (150 * (x + at(i + 1)) - 25 * (at(i - 1) + at(i + 2)) + 3 * (at(i - 2) + at(i + 3)) + 128) // 256)))]
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WAVE" + body, twice


def test_telephony_files_and_features(spark, sf):
    raw = texts(spark, sf)
    some = {r["doc_id"]: r for r in run(spark, sf, "op4_telephony") if len(raw[r["doc_id"]]) < 3000}
    seen = set()
    for i, r in list(some.items())[:80]:
        b = raw[i]
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(b) % 3]
        media, pcm = _media(p, codec)
        seen.add(codec)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        crossings = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:]))
        stored = b"".join(x.to_bytes(2, "little", signed=True) for x in pcm)
        assert r["feature"] == f"{codec}:16000:{max(map(abs, pcm))}:{crossings}:{sum(map(abs, pcm)) // len(pcm)}:{zlib.crc32(stored):08x}" and r["pcm_bytes"] == len(stored)
    assert len(seen) == 3


def test_simhash_classes(spark, sf):
    def fingerprint(t):
        w = WORD.findall(t.lower())
        runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts(spark, sf).items()}
    root = {f: f for f in prints.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for i, f in prints.items():
        least[find(f)] = min(i, least.get(find(f), i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, sf, "op5_simhash")}
    assert got == {i: (f"{f:016x}", least[find(f)]) for i, f in prints.items()}


def test_decontamination(spark, sf):
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = ALNUM.findall((r["text"] or "").encode().lower())
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])].add(str(r["item_id"]))
    sizes = {len(k) for k in windows}
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_decontamination")}
    for i, t in texts(spark, sf).items():
        w, hit, items = ALNUM.findall(t.lower()), set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if found := windows.get(tuple(w[j : j + size])):
                    hit.update(range(j, j + size))
                    items |= found
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


def test_html_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in run(spark, sf, "op10_html"):
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = corpus_pipeline.run(spark, sf)
    assert 0 < found.count() < docs.count() and found.select("doc_id").distinct().count() == found.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    rng = random.Random(3)
    prose = " ".join(rng.choice("alpha beta gamma delta omega kappa".split()) + str(i % 7) for i in range(400))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, prose, "en", "s"), (3, prose, "en", "s"), (4, prose + " more", None, "s"), (5, "word " * 300_000, "fr", None), (None, prose, "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "id", "row", "component", "n_words", "spans", "items", "place", "key", "kind"):
        docs = docs.withColumn(name, F.lit("mine"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = stage(spark, docs, sf)
        if k < 4:
            assert got.columns == docs.columns and got.where("score <> 'mine' OR id <> 'mine' OR row <> 'mine' OR items <> 'mine'").count() == 0
        kept = sorted(str(r["doc_id"]) for r in got.collect())
        if k == 2:
            assert kept == ["1", "3", "5", "None", "None"]
        if k == 3:
            assert len(kept) == 8


def test_pipeline_is_its_stages_one_by_one(spark, sf):
    """Near copies and benchmark passages against brute force on what the stages before them kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= set(before) and len(kept) == docs.count()
        if k == 2:
            sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := WORD.findall(t.lower())) else frozenset() for i, t in before.items()}
            root = {i: i for i in sets}
            for i in sorted(sets):
                for j in sorted(sets):
                    if j < i and root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                        a, b = sorted((root[i], root[j]))
                        root = {x: a if r == b else r for x, r in root.items()}
            assert kept == set(root.values())
        if k == 3:
            patterns = {" " + b" ".join(w[j : j + min(10, len(w))]).decode() + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := ALNUM.findall((r["text"] or "").encode().lower())) for j in range(len(w) - min(10, len(w)) + 1)}
            hit = {i for i, t in before.items() if any(p in " " + b" ".join(ALNUM.findall(t.lower())).decode() + " " for p in patterns)}
            assert kept == set(before) - hit
