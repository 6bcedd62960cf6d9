"""Queries from raw text: assessment, offline tone and summary, the chunk store, answers, approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.functions import text
from stancelake.operators import assessment, blocks, retrieval, speeches, vector_index
from stancelake.plans.registry import register
from stancelake.plans.retrieval import _ALL_SQL
from stancelake.plans.roles import rounded
from stancelake.plans.text import _hits_sql, chunks_sql
from stancelake.session import new_folder, table, texts

#: The invented prose gets words of the domain for some of its own.
SPOKEN = ((" of ", " rate hike "), (" was ", " easing "), (" with ", " not "), (" that ", " outlook will "))

CHECK_HAWKISH, CHECK_DOVISH = ("hike", "outlook", "the"), ("easing", "in")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, headline, bank: documents in the role of speeches."""
    said = F.lower("text")
    for a, b in SPOKEN:
        said = F.replace(said, F.lit(a), F.lit(b))
    bank = F.when(F.col("lang") == "en", assessment.CLASSIFIER_BANKS[0]).otherwise(F.col("lang"))
    return texts(spark, sf_dir, "doc_id", "text", "n_chars", "lang").select("doc_id", said.alias("text"), ((F.col("n_chars") % 201 - 100) / F.lit(100.0)).alias("headline"), bank.alias("bank"))


_SAID = "lower(text)"
for _a, _b in SPOKEN:
    _SAID = f"replace({_SAID}, '{_a}', '{_b}')"
_SPEECH_SQL = rf"""sp AS (SELECT doc_id, {_SAID} AS text, (n_chars % 201 - 100) / 100.0::DOUBLE AS headline, lang = 'en' AS applies FROM documents),
s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS l FROM sp)),
v AS (SELECT *, {_hits_sql('sentence', text.HAWKISH_TERMS)} AS h, {_hits_sql('sentence', text.DOVISH_TERMS)} AS d FROM s)"""


def _aspect_sql() -> str:
    hits = [(name, _hits_sql("sentence", terms)) for name, terms in text.ASPECT_CUES]
    most = f"greatest({', '.join(h for _, h in hits)})"
    return "CASE WHEN " + most + " = 0 THEN 'other' " + " ".join(f"WHEN {h} = {most} THEN '{name}'" for name, h in hits) + " END"


_side = lambda x: f"CASE WHEN {x} > 0.05 THEN 1 WHEN {x} < -0.05 THEN -1 ELSE 0 END"
_NEGATORS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(text.NEGATORS)) + "]"

_ASSESSED_SQL = f"""WITH {_SPEECH_SQL},
g AS (SELECT *, {_hits_sql('sentence', text.FORWARD_CUES)} > {_hits_sql('sentence', text.BACKWARD_CUES)} AS ahead, {_aspect_sql()} AS aspect, {_hits_sql('sentence', CHECK_HAWKISH)} AS ch, {_hits_sql('sentence', CHECK_DOVISH)} AS cd FROM v WHERE {_hits_sql('sentence', text.POLICY_TERMS)} > 0),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (h > d) AS hw, count(*) FILTER (h < d) AS dv, count(*) FILTER (ahead) AS fn, count(*) FILTER (ahead AND h > d) AS fh, count(*) FILTER (ahead AND h < d) AS fd, count(*) FILTER (ch > cd) AS kh, count(*) FILTER (ch < cd) AS kd, count(DISTINCT aspect) AS n_aspects FROM g GROUP BY doc_id),
ns AS (SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id),
t AS (SELECT doc_id, regexp_extract_all(text, '[a-z'']+') AS t FROM sp),
x AS (SELECT doc_id, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] = 'rate' AND t[i + 1] = 'hike' THEN CASE WHEN list_has_any(t[greatest(i - 3, 1):i - 1], {_NEGATORS_SQL}) THEN -1 ELSE 1 END WHEN t[i] = 'easing' THEN CASE WHEN list_has_any(t[greatest(i - 3, 1):i - 1], {_NEGATORS_SQL}) THEN 1 ELSE -1 END END), lambda y: y IS NOT NULL) AS hits FROM t),
l AS (SELECT doc_id, len(hits) > 0 AS fired, coalesce(list_sum(hits) / nullif(len(hits), 0), 0.0) AS lexicon_score FROM x),
a AS (SELECT doc_id, headline, coalesce(sentences, 0) AS sentences, coalesce(hw, 0) AS hawkish, coalesce(dv, 0) AS dovish, coalesce(n, 0) AS relevant, coalesce((hw - dv) / n, 0.0) AS net, coalesce((fh - fd) / nullif(fn, 0), 0.0) AS forward_net, coalesce((kh - kd) / n, 0.0) AS classifier_net, lexicon_score, fired, applies, coalesce(n_aspects, 0) AS n_aspects
  FROM sp LEFT JOIN ns USING (doc_id) LEFT JOIN c USING (doc_id) JOIN l USING (doc_id)),
k AS (SELECT *, {_side('headline')} AS w, {_side('net')} AS ds, {_side('classifier_net')} AS dc, {_side('lexicon_score')} AS dx FROM a),
u AS (SELECT *, (CASE WHEN w = 0 THEN (ds <> 0)::INT ELSE (ds = -w)::INT END + CASE WHEN applies THEN CASE WHEN w = 0 THEN (dc <> 0)::INT ELSE (dc = -w)::INT END ELSE 0 END + CASE WHEN fired THEN CASE WHEN w = 0 THEN (dx <> 0)::INT ELSE (dx = -w)::INT END ELSE 0 END) / (1 + applies::INT + fired::INT) AS u FROM k)
SELECT doc_id, headline, CAST(sentences AS INTEGER) AS sentences, CAST(hawkish AS INTEGER) AS hawkish, CAST(dovish AS INTEGER) AS dovish, CAST(relevant AS INTEGER) AS relevant, round(net, 9) + 0.0 AS net, round(forward_net, 9) + 0.0 AS forward_net,
  CASE WHEN relevant = 0 THEN 'neutral' WHEN hawkish >= 0.25 * relevant AND dovish >= 0.25 * relevant THEN 'mixed' WHEN abs(net) < 0.05 THEN 'neutral' WHEN net > 0 THEN 'hawkish' ELSE 'dovish' END AS tone,
  round(classifier_net, 9) + 0.0 AS classifier_net, round(lexicon_score, 9) + 0.0 AS lexicon_score, fired, CAST(n_aspects AS INTEGER) AS n_aspects, round(u, 9) + 0.0 AS uncertainty, u >= 0.5 AS needs_review, false AS degraded FROM u"""


@register("stance_assessment", _ASSESSED_SQL)
def stance_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path with the domain's default terms."""
    found = assessment.assess(spoken(spark, sf_dir), assessment.by_terms(), assessment.by_terms(CHECK_HAWKISH, CHECK_DOVISH))
    return found.select(
        "doc_id", "headline", "sentences", "hawkish", "dovish", "relevant", *rounded("net", "forward_net"), "tone", *rounded("classifier_net", "lexicon_score"), "fired", F.size("aspects").alias("n_aspects"), *rounded("uncertainty"), "needs_review", "degraded",
    )


@register("offline_tone", f"""WITH {_SPEECH_SQL}, c AS (SELECT doc_id, count(*) FILTER (h > d) AS h, count(*) FILTER (h < d) AS d, count(*) AS n FROM v GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(h, 0) AS h, coalesce(d, 0) AS d, coalesce(n, 1) AS n FROM sp LEFT JOIN c USING (doc_id)), b AS (SELECT *, coalesce((h - d) / nullif(h + d, 0), 0.0) AS score FROM a)
SELECT doc_id, CAST(h AS INTEGER) AS hawkish, CAST(d AS INTEGER) AS dovish, CAST(n AS INTEGER) AS sentences, round(score, 9) + 0.0 AS score, CASE WHEN h + d = 0 OR abs(score) < 0.1 THEN 'neutral' WHEN score > 0 THEN 'hawkish' ELSE 'dovish' END AS tone FROM b""")
def offline_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assessment.offline_tone(spoken(spark, sf_dir), assessment.by_terms())
    return found.select("doc_id", "hawkish", "dovish", "sentences", *rounded("score"), "tone")


@register("offline_summary", f"""WITH {_SPEECH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos > 1, round(abs(coalesce((h - d) / nullif(h + d, 0), 0.0)), 12) DESC, pos) AS k FROM v),
j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE k <= 3 GROUP BY doc_id) SELECT doc_id, coalesce(summary, '(no text)') AS summary FROM sp LEFT JOIN j USING (doc_id)""")
def offline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.offline_summary(spoken(spark, sf_dir), assessment.by_terms())


def _speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "doc_id", "source", "text")
    return rows.select(F.col("doc_id").alias("speech_id"), F.col("source").alias("speaker_id"), "text", F.concat(F.lit("Speech "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"))


DIM = 256

QUESTION = "the reason that it was with the other"


def _store(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = new_folder(spark, "chunks")
    speeches.index_speeches(rows, path, speeches.hash_embedder(DIM))
    return spark.read.parquet(path)


@register("index_speeches", f"WITH RECURSIVE {chunks_sql()} SELECT doc_id AS speech_id, count(*) AS chunks FROM c GROUP BY doc_id")
def index_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each speech after it was indexed twice; the second time adds none."""
    path, rows, embed = new_folder(spark, "chunks"), _speeches(spark, sf_dir), speeches.hash_embedder(DIM)
    speeches.index_speeches(rows, path, embed)
    speeches.index_speeches(rows, path, embed)
    return speeches.chunk_counts(spark.read.parquet(path))


@register("ask_corpus")
def ask_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speeches(spark, sf_dir)
    return speeches.ask_corpus(_store(spark, rows), rows, QUESTION, speeches.hash_embedder(DIM), most_distance=0.95)


@register("ask_speaker")
def ask_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked of the speaker that comes first by name."""
    rows = _speeches(spark, sf_dir)
    first = rows.agg(F.min("speaker_id")).first()[0]
    return speeches.ask_speaker(_store(spark, rows), rows, rows.select("speaker_id"), first, QUESTION, speeches.hash_embedder(DIM), most_distance=0.95)


def _grams_of_sql(name: str, source: str) -> str:
    """CTE of (doc_id, k, i, x): the vectors of source (doc_id, k, text), place by place, of md5 of one and two words."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, k, i, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, k)) AS FLOAT)::DOUBLE AS x FROM (
  SELECT doc_id, k, CAST(h % {DIM} AS INTEGER) AS i, sum(CASE WHEN (h // 8589934592) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n FROM (
    SELECT doc_id, k, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, k, unnest(list_concat(t, list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]))) AS g FROM (SELECT doc_id, k, regexp_extract_all(lower(text), '[a-z]+') AS t FROM ({source})))) GROUP BY ALL HAVING n <> 0))"""


_TRIM_SQL = r"regexp_replace({0}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"


def _asked_sql(where: str, nothing: str, most_distance: float) -> str:
    """The whole path: chunks, their vectors, the nearest five within the distance, their sentences, the answer."""
    return f"""WITH RECURSIVE {chunks_sql(source=f'SELECT doc_id, text FROM documents {where}')},
{_grams_of_sql('v', 'SELECT doc_id, chunk_index AS k, text FROM c')}, {_grams_of_sql('q', f"SELECT 0 AS doc_id, 0 AS k, '{QUESTION}' AS text")},
d AS (SELECT c.doc_id, c.chunk_index, text, 1 - coalesce(dot / (sqrt(vv) * (SELECT sqrt(sum(x * x)) FROM q)), 0) AS distance FROM c LEFT JOIN (SELECT v.doc_id, v.k, sum(v.x * q.x) AS dot, sum(v.x * v.x) AS vv FROM v LEFT JOIN q USING (i) GROUP BY ALL) s ON c.doc_id = s.doc_id AND c.chunk_index = s.k),
f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(distance, 12), doc_id, chunk_index) AS nth FROM (SELECT * FROM d ORDER BY round(distance, 12), doc_id, chunk_index LIMIT 5) WHERE distance <= {most_distance}),
s AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY nth, j) AS k, x AS text FROM (SELECT doc_id, nth, unnest(range(1, len(l) + 1)) AS j, unnest(l) AS x FROM (SELECT doc_id, nth, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda y: {_TRIM_SQL.format('y')}), lambda y: y <> '') AS l FROM f)) WHERE len(string_split(x, ' ')) >= 4),
{_grams_of_sql('u', 'SELECT doc_id, k, text FROM s')},
m AS (SELECT s.doc_id, s.k, s.text, round(coalesce(like_, 0), 9) AS like_ FROM s LEFT JOIN (SELECT u.k, sum(u.x * q.x) AS like_ FROM u JOIN q USING (i) GROUP BY u.k) w ON s.k = w.k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY like_ DESC, k) AS again FROM m) WHERE again = 1 ORDER BY like_ DESC, k LIMIT 3),
o AS (SELECT string_agg('- ' || text || ' (Speech ' || doc_id || ')', chr(10) ORDER BY like_ DESC, k) AS lines FROM b),
g AS (SELECT string_agg(doc_id || ':' || chunk_index, ',' ORDER BY nth) AS cited, count(*) AS n, any_value('- ' || {_TRIM_SQL.format('text')} || ' (Speech ' || doc_id || ')') FILTER (nth = 1) AS first_ FROM f)
SELECT CASE WHEN n = 0 THEN '{nothing.replace("'", "''")}' ELSE '{speeches.PREFIX}' || chr(10) || chr(10) || coalesce(lines, first_) END AS answer, coalesce(cited, '') AS cited, n = 0 AS abstained FROM o, g"""


def _shown(found: DataFrame) -> DataFrame:
    cited = F.transform("citations", lambda c: F.concat(c["speech_id"].cast("string"), F.lit(":"), c["chunk_index"].cast("string")))
    return found.select("answer", F.array_join(cited, ",").alias("cited"), "abstained")


def _md5_store(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, speeches.Embedder]:
    path, embed = new_folder(spark, "chunks"), speeches.hash_embedder(DIM, "md5")
    speeches.index_speeches(rows, path, embed)
    return spark.read.parquet(path), embed


@register("ask_corpus_md5", _asked_sql("", speeches.NOTHING_OF_ANY, 0.95))
def ask_corpus_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question to all speeches, with vectors that SQL can make as well."""
    rows = _speeches(spark, sf_dir)
    store, embed = _md5_store(spark, rows)
    return _shown(speeches.ask_corpus(store, rows, QUESTION, embed, most_distance=0.95))


@register("ask_speaker_md5", _asked_sql("WHERE source = (SELECT min(source) FROM documents)", speeches.NOTHING_OF_SPEAKER, 0.95))
def ask_speaker_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question to the speaker that comes first by name; all speeches are indexed."""
    rows = _speeches(spark, sf_dir)
    store, embed = _md5_store(spark, rows)
    first = rows.agg(F.min("speaker_id")).first()[0]
    return _shown(speeches.ask_speaker(store, rows, rows.select("speaker_id"), first, QUESTION, embed, most_distance=0.95))


@register("ask_speaker_nothing", _asked_sql("WHERE source = (SELECT max(source) FROM documents)", speeches.NOTHING_OF_SPEAKER, 0.01))
def ask_speaker_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance that no chunk is within: an abstention, which cites nothing."""
    rows = _speeches(spark, sf_dir)
    store, embed = _md5_store(spark, rows)
    last = rows.agg(F.max("speaker_id")).first()[0]
    return _shown(speeches.ask_speaker(store, rows, rows.select("speaker_id"), last, QUESTION, embed, most_distance=0.01))


@register("nearest_by_lists")
def nearest_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every vector whose id is divisible by 100, from an index of all."""
    vectors = table(spark, sf_dir, "embeddings")
    found = speeches.nearest_by_lists(vectors, vectors.where("vec_id % 100 = 0"), speeches.centroids(vectors, 16), 5, 8)
    return found.select("query", "id", (F.abs(F.round("distance", 9)) + 0.0).alias("distance"), "rank")


def _indexed(spark: SparkSession, sf_dir: str, batches: int = 3) -> tuple[DataFrame, vector_index.ListIndex]:
    """All vectors, and an index that they were added to in batches."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vector_index.ListIndex(spark, new_folder(spark, "index"))
    part = lambda k: vectors.where(F.pmod("vec_id", F.lit(batches)) == k)  # noqa: E731  every vector is in one of them
    index.create(part(0), lists=16)
    for k in range(1, batches):
        index.append(part(k), f"batch-{k}")
    return vectors, index


@register("index_search", _ALL_SQL)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector from the stored index, all of whose lists are probed: exact."""
    vectors, index = _indexed(spark, sf_dir)
    return index.search(vectors, 5, probes=16).select("query", "id", (F.abs(F.round("distance", 9)) + 0.0).alias("distance"), "rank")


@register("index_recall", "SELECT count(*) AS queries, count(*) AS first_found, true AS good FROM embeddings")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector, with 14 of 16 lists probed: whether it finds itself, and whether 0.95 of all neighbours are found."""
    vectors, index = _indexed(spark, sf_dir)
    named = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found, exact = index.search(vectors, 5, probes=14), blocks.nearest(named, named, 5)
    both = exact.select("query", "id", "rank").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.count_if(F.col("rank") == 1).alias("queries"), F.count_if((F.col("rank") == 1) & F.col("hit").isNotNull()).alias("first_found"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("good"))


@register("hash_embedding_components")
def hash_embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every document's vector that is not zero."""
    vectors = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(retrieval.text_embedding(F.col("text"))).alias("place", "value"))
    return vectors.where("value <> 0").select("doc_id", "place", *rounded("value"))
