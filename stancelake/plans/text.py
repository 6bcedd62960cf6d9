"""Queries over texts: sentences, gates, cues, stance, lexicon, chunks, n-grams, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.functions import text
from stancelake.operators import boards, features, heavy, stance
from stancelake.plans.registry import register
from stancelake.plans.roles import OBSERVATIONS_SQL, observations, rounded, rounded_sql
from stancelake.session import texts

#: Terms that the invented prose of the benchmark has; the domain's own terms do not occur in it.
RELEVANT = ("the", "that", "was", "of the")
CUES = (("first", ("that", "for")), ("second", ("was", "with", "of the")), ("third", ("her", "from")))
FORWARD, BACKWARD = ("will", "to the", "that"), ("was", "were", "on the")
HAWKISH, DOVISH = ("anthe", "that", "the of"), ("was", "of", "the")

_SENTENCES_SQL = r"s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '')) AS sentence FROM documents)"


def _hits_sql(column: str, terms: tuple[str, ...]) -> str:
    words = [t for t in sorted(set(terms)) if " " not in t]
    parts = [f"len(list_intersect(list_distinct(regexp_extract_all(lower({column}), '[a-z'']+')), [{', '.join(repr(w) for w in words)}]))"] if words else []
    parts += [f"contains(lower({column}), '{p}')::INT" for p in sorted(set(terms)) if " " in p]
    return "(" + " + ".join(parts) + ")"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


@register("sentence_counts", f"WITH {_SENTENCES_SQL} SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM s GROUP BY doc_id")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.char_length("sentence")).alias("chars"))


@register("relevance_gate", f"WITH {_SENTENCES_SQL} SELECT doc_id, count(*) AS sentences, count(*) FILTER ({_hits_sql('sentence', RELEVANT)} > 0) AS relevant FROM s GROUP BY doc_id")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(text.is_relevant(F.col("sentence"), RELEVANT)).alias("relevant"))


def _aspect_sql(column: str) -> str:
    hits = [(name, _hits_sql(column, terms)) for name, terms in CUES]
    most = f"greatest({', '.join(h for _, h in hits)})"
    return "CASE WHEN " + most + " = 0 THEN 'other' " + " ".join(f"WHEN {h} = {most} THEN '{name}'" for name, h in hits) + " END"


def _horizon_sql(column: str) -> str:
    a, b = _hits_sql(column, FORWARD), _hits_sql(column, BACKWARD)
    return f"CASE WHEN {a} > {b} THEN 'forward' WHEN {b} > {a} THEN 'backward' ELSE 'unspecified' END"


@register("aspect_horizon", f"WITH {_SENTENCES_SQL} SELECT aspect, horizon, count(*) AS n FROM (SELECT {_aspect_sql('sentence')} AS aspect, {_horizon_sql('sentence')} AS horizon FROM s) GROUP BY ALL")
def aspect_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).select(text.aspect(F.col("sentence"), CUES).alias("aspect"), text.horizon(F.col("sentence"), FORWARD, BACKWARD).alias("horizon"))
    return rows.groupBy("aspect", "horizon").agg(F.count(F.lit(1)).alias("n"))


_LABELLED_SQL = f"{_SENTENCES_SQL}, l AS (SELECT doc_id, CASE WHEN {_hits_sql('sentence', HAWKISH)} > {_hits_sql('sentence', DOVISH)} THEN 'hawkish' WHEN {_hits_sql('sentence', HAWKISH)} < {_hits_sql('sentence', DOVISH)} THEN 'dovish' ELSE 'neutral' END AS label, {_aspect_sql('sentence')} AS aspect, {_horizon_sql('sentence')} AS horizon FROM s WHERE {_hits_sql('sentence', RELEVANT)} > 0)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant sentences with a label by which terms have more hits, an aspect and a horizon."""
    s = F.col("sentence")
    h, d = text.term_hits(s, HAWKISH), text.term_hits(s, DOVISH)
    rows = _sentences(spark, sf_dir).where(text.is_relevant(s, RELEVANT))
    return rows.select("doc_id", F.when(h > d, "hawkish").when(h < d, "dovish").otherwise("neutral").alias("label"), text.aspect(s, CUES).alias("aspect"), text.horizon(s, FORWARD, BACKWARD).alias("horizon"))


@register("stance_aggregate", f"""WITH {_LABELLED_SQL}, c AS (SELECT doc_id, count(*) FILTER (label = 'hawkish') AS hawkish, count(*) FILTER (label = 'dovish') AS dovish, count(*) AS relevant,
  count(*) FILTER (label = 'hawkish' AND horizon = 'forward') AS h, count(*) FILTER (label = 'dovish' AND horizon = 'forward') AS d, count(*) FILTER (horizon = 'forward') AS r FROM l GROUP BY doc_id)
SELECT doc_id, hawkish, dovish, relevant - hawkish - dovish AS neutral, relevant, round((hawkish - dovish) / relevant, 9) + 0.0 AS net, round(coalesce((h - d) / nullif(r, 0), 0.0), 9) + 0.0 AS forward_net,
  CASE WHEN hawkish >= 0.25 * relevant AND dovish >= 0.25 * relevant THEN 'mixed' WHEN abs((hawkish - dovish) / relevant) < 0.05 THEN 'neutral' WHEN hawkish > dovish THEN 'hawkish' ELSE 'dovish' END AS tone,
  round((hawkish + dovish) / relevant, 9) AS directional_share, hawkish + dovish > 0 AS fired FROM c""")
def stance_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stance.aggregate(labelled(spark, sf_dir))
    return found.select("doc_id", "hawkish", "dovish", "neutral", "relevant", *rounded("net", "forward_net"), "tone", *rounded("directional_share"), "fired")


@register("aspect_breakdown", f"WITH {_LABELLED_SQL} SELECT doc_id, aspect, round((count(*) FILTER (label = 'hawkish') - count(*) FILTER (label = 'dovish')) / count(*), 9) + 0.0 AS net, count(*) AS relevant FROM l GROUP BY ALL")
def aspect_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.by_aspect(labelled(spark, sf_dir)).select("doc_id", "aspect", *rounded("net"), "relevant")


def _side(x: str) -> str:
    return f"CASE WHEN {x} > 0.05 THEN 1 WHEN {x} < -0.05 THEN -1 ELSE 0 END"


@register("ensemble_review", f"""WITH {OBSERVATIONS_SQL}, e AS (SELECT id, score, lexicon_score AS s, floor((id % 401 - 200.0::DOUBLE) * 50.0::DOUBLE) / 10000.0::DOUBLE AS c, floor((id % 301 - 150.0::DOUBLE) * 60.0::DOUBLE) / 10000.0::DOUBLE AS x, id % 3 <> 0 AS fired, bank = 'AMERICA' AS applies FROM o),
k AS (SELECT *, {_side('score')} AS w, {_side('s')} AS ds, {_side('c')} AS dc, {_side('x')} AS dx FROM e),
u AS (SELECT id, (CASE WHEN w = 0 THEN (ds <> 0)::INT ELSE (ds = -w)::INT END + CASE WHEN applies THEN CASE WHEN w = 0 THEN (dc <> 0)::INT ELSE (dc = -w)::INT END ELSE 0 END
  + CASE WHEN fired THEN CASE WHEN w = 0 THEN (dx <> 0)::INT ELSE (dx = -w)::INT END ELSE 0 END) / (1 + applies::INT + fired::INT) AS u FROM k)
SELECT id, round(u, 9) AS uncertainty, u >= 0.5 AS needs_review FROM u""")
def ensemble_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    classifier = F.floor((F.col("id") % 401 - F.lit(200.0)) * 50) / 10000
    lexicon = F.floor((F.col("id") % 301 - F.lit(150.0)) * 60) / 10000
    uncertainty, review = stance.combine(F.col("score"), F.col("lexicon_score"), classifier, lexicon, F.col("id") % 3 != 0, F.col("bank") == "AMERICA")
    return rows.select("id", F.round(uncertainty, 9).alias("uncertainty"), review.alias("needs_review"))


def _lexicon_sql(hawkish: tuple[str, ...], dovish: tuple[str, ...]) -> str:
    """Terms of one word, or of two with a space between that no other term reaches over: the longer counts, negators flip.

    Texts are cut into words and what is between them, so that a term is a word, or two around a space.
    """
    quoted = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"
    pairs = [(t.split(), sign) for terms, sign in ((hawkish, 1), (dovish, -1)) for t in terms if " " in t]
    single = lambda terms: [t for t in terms if " " not in t]
    begins = " ".join(f"WHEN w = '{a}' AND w1 = ' ' AND w2 = '{b}' THEN {sign}" for (a, b), sign in pairs)
    within = " OR ".join(f"(w = '{b}' AND b1 = ' ' AND b2 = '{a}')" for (a, b), _ in pairs)
    return rf"""WITH e AS (SELECT doc_id, i, t[i] AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS t FROM documents))),
n AS (SELECT doc_id, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lag(w) OVER o AS b1, lag(w, 2) OVER o AS b2, string_agg(w, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS before FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, before, CASE {begins} WHEN {within} THEN NULL WHEN w IN {quoted(single(hawkish))} THEN 1 WHEN w IN {quoted(single(dovish))} THEN -1 END AS sign FROM n),
s AS (SELECT doc_id, CASE WHEN list_has_any(regexp_extract_all(coalesce(before, ''), '[a-z'']+')[-{text.NEGATION_WINDOW}:], [{quoted(text.NEGATORS)[1:-1]}]) THEN -sign ELSE sign END AS sign FROM h WHERE sign IS NOT NULL),
c AS (SELECT d.doc_id, count(*) FILTER (sign = 1) AS h, count(*) FILTER (sign = -1) AS d FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, coalesce((h - d) / nullif(h + d, 0), 0.0) AS score, CAST(h AS INTEGER) AS hawkish_hits, CAST(d AS INTEGER) AS dovish_hits FROM c"""


@register("lexicon_scores", _lexicon_sql(HAWKISH, DOVISH))
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = text.lexicon(HAWKISH, DOVISH)
    found = texts(spark, sf_dir, "doc_id", "text").select("doc_id", score(F.col("text")).alias("found"))
    return found.select("doc_id", "found.score", "found.hawkish_hits", "found.dovish_hits")


_PLAIN_H, _PLAIN_D = ("that", "from"), ("was", "with")
_count_sql = lambda terms: " + ".join(f"len(regexp_extract_all(lower(text), '\\b{t}\\b'))" for t in terms)


@register("lexicon_scores_plain", rf"""WITH c AS (SELECT doc_id, {_count_sql(_PLAIN_H)} AS h, {_count_sql(_PLAIN_D)} AS d FROM documents WHERE lang = 'en' AND regexp_full_match(text, '[\x00-\x7F]*'))
SELECT doc_id, round(coalesce((h - d) / nullif(h + d, 0), 0.0), 9) + 0.0 AS score, CAST(h AS INTEGER) AS hawkish_hits, CAST(d AS INTEGER) AS dovish_hits FROM c""")
def lexicon_scores_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms without overlaps or negators in texts of plain letters, which SQL can count."""
    score = text.lexicon(_PLAIN_H, _PLAIN_D, negators=frozenset())
    rows = texts(spark, sf_dir, "doc_id", "lang", "text").where((F.col("lang") == "en") & F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("doc_id", score(F.col("text")).alias("found")).select("doc_id", (F.round("found.score", 9) + F.lit(0.0)).alias("score"), "found.hawkish_hits", "found.dovish_hits")


# words of each text with the lengths up to each; then chunk after chunk, each begun by words of the one before
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+')"


def chunks_sql(most: int = 1000, overlap: int = 100, source: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs w and c (doc_id, chunk_index, text): what text.chunk makes of every text of the source."""
    return f"""w AS MATERIALIZED (SELECT doc_id, n, list(word ORDER BY i) AS t, list_prepend(0, list(s ORDER BY i)) AS p FROM (SELECT doc_id, n, i, t[i] AS word, sum(length(t[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS s
  FROM (SELECT doc_id, t, len(t) AS n, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS t FROM ({source})))) GROUP BY doc_id, n),
e(doc_id, chunk_index, a, b) AS (SELECT doc_id, 0, 0, coalesce(list_filter(range(1, n), lambda q: p[q + 2] > {most})[1], n) FROM w
  UNION ALL SELECT f.doc_id, f.chunk_index + 1, f.back, coalesce(list_filter(range(f.b + 1, w.n), lambda q: w.p[q + 2] - w.p[f.back + 1] > {most})[1], w.n)
  FROM (SELECT e.doc_id, e.chunk_index, e.b, coalesce(list_filter(range(e.a, e.b), lambda k: w.p[e.b + 1] - w.p[k + 1] <= {overlap})[1], e.b) AS back FROM e JOIN w USING (doc_id) WHERE e.b < w.n) f JOIN w USING (doc_id)),
c AS MATERIALIZED (SELECT doc_id, chunk_index, array_to_string(t[a + 1:b], ' ') AS text FROM e JOIN w USING (doc_id))"""


@register("chunk_documents", f"WITH RECURSIVE {chunks_sql()} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS sha256 FROM c")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(text.chunk(F.col("text"))).alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", F.char_length("text").alias("chars"), text.sha256(F.col("text")).alias("sha256"))


_GRAMS_SQL = "w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM w), tf AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 3)"


@register("vocabulary_heavy", f"WITH {_GRAMS_SQL} SELECT gram, df, CAST(row_number() OVER (ORDER BY gram) - 1 AS INTEGER) AS place FROM (SELECT gram, df FROM df ORDER BY df DESC, gram LIMIT 5000)")
def vocabulary_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary from bounded summaries of the tasks and an exact count of what they leave."""
    return heavy.vocabulary(texts(spark, sf_dir, "doc_id", "text")).withColumnRenamed("column", "place")


@register("ngram_document_frequency", f"WITH {_GRAMS_SQL} SELECT gram, df FROM df")
def ngram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.gram_counts(texts(spark, sf_dir, "doc_id", "text"), 3)


_VOCABULARY_SQL = f"{_GRAMS_SQL}, v AS (SELECT gram, df, row_number() OVER (ORDER BY gram) - 1 AS column FROM (SELECT * FROM df ORDER BY df DESC, gram LIMIT 5000)), dn AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, gram, (1 + ln(tf.n)) * (ln((1 + dn.n) / (1 + df)) + 1) AS raw FROM tf JOIN v USING (gram), dn), xx AS (SELECT doc_id, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM x)"


@register("tfidf_top_terms", f"WITH {_VOCABULARY_SQL} SELECT doc_id, gram, round(weight, 9) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, gram) AS rank FROM xx) WHERE rank <= 5")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir, "doc_id", "text")
    return features.top_terms(features.tfidf(documents), 5).select("doc_id", "gram", *rounded("weight"), "rank")


@register("classifier_scores", f"""WITH {_VOCABULARY_SQL}, z AS (SELECT doc_id, sum(weight * (ascii(gram) % 7 - 3)) / 4 AS zh, sum(weight * (length(gram) % 5 - 2)) / 4 AS zd FROM xx GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(zh, 0) + 0.1 AS h, coalesce(zd, 0) AS d, 0.2 AS n FROM documents LEFT JOIN z USING (doc_id)), e AS (SELECT doc_id, exp(h) AS h, exp(d) AS d, exp(n) AS n FROM a)
SELECT doc_id, round((h - d) / (h + d + n), 9) + 0.0 AS score, round(greatest(h, d, n) / (h + d + n), 9) AS confidence, CASE WHEN h >= d AND h >= n THEN 'hawkish' WHEN d >= n THEN 'dovish' ELSE 'neutral' END AS label FROM e""")
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir, "doc_id", "text")
    weights = features.tfidf(documents)
    coefficients = {"hawkish": (F.ascii("gram") % 7 - 3) / F.lit(4.0), "dovish": (F.char_length("gram") % 5 - 2) / F.lit(4.0), "neutral": F.lit(0.0)}
    found = features.softmax_scores(documents, weights, coefficients, {"hawkish": 0.1, "dovish": 0.0, "neutral": 0.2})
    return found.select("doc_id", *rounded("score", "confidence"), "label")
