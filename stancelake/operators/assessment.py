"""From raw text to an assessed stance: sentences, gate, scorer, counts, cross-checks, review.

A scorer is an expression: array<string> of sentences -> array<struct<label, score>>, one verdict for each. All
that is of one text stays in its row, as arrays, so an assessment shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.functions import matching, text
from stancelake.operators import stance

Scorer = Callable[[Column], Column]

VERDICTS = "array<struct<label:string,score:double>>"

#: Least share of sentences and verdicts that must stand side by side.
LEAST_ALIGNED = 0.8

#: Banks whose own texts the trained classifier has seen; elsewhere it is no cross-check.
CLASSIFIER_BANKS = ("federal_reserve",)

# What is said for an empty text, and the rationale of the offline tone.
NO_TEXT = "(no text)"
RATIONALE = "Offline supervised classifier (no LLM): %d/%d hawkish, %d/%d dovish, %d/%d neutral sentences; net hawkishness %+.2f."


#: What is looked up in every sentence besides the terms of the gate: aspects, and whether it looks ahead or back.
CUES = {f"aspect {name}": terms for name, terms in text.ASPECT_CUES} | {"forward": text.FORWARD_CUES, "backward": text.BACKWARD_CUES}


def _aspect_of(hits: Column) -> Column:
    """The first listed of the aspects with most hits; other without any. hits: counts in the order of CUES."""
    mine = F.slice(hits, 1, len(text.ASPECT_CUES))
    names = F.array(*[F.lit(name) for name, _ in text.ASPECT_CUES])
    return F.when(F.array_max(mine) > 0, F.element_at(names, F.array_position(mine, F.array_max(mine)).cast("int"))).otherwise("other")


def _horizon_of(hits: Column) -> Column:
    """text.horizon from counts in the order of CUES."""
    ahead, behind = (F.element_at(hits, len(text.ASPECT_CUES) + k) for k in (1, 2))
    return F.when(ahead > behind, "forward").when(ahead < behind, "backward").otherwise("unspecified")


def by_terms(hawkish: Sequence[str] = text.HAWKISH_TERMS, dovish: Sequence[str] = text.DOVISH_TERMS) -> Scorer:
    """Verdicts by which side's terms have more hits in a sentence; score is their balance."""
    terms = matching.Terms({"hawkish": hawkish, "dovish": dovish})

    def verdict(raw: str) -> dict:
        h, d = map(int, terms.counts(raw))
        return {"label": "hawkish" if h > d else "dovish" if h < d else "neutral", "score": (h - d) / (h + d) if h + d else 0.0}

    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(VERDICTS)
    def verdicts(sentences: pa.Array) -> pa.Array:
        return text.by_steps(sentences, lambda rows: [[verdict(s) for s in mine] if mine is not None else None for mine in rows], kind)

    return verdicts


def by_softmax(terms: Sequence[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, classes: tuple[str, ...] = ("hawkish", "dovish", "neutral")) -> Scorer:
    """Verdicts of a trained classifier over TF-IDF of one and two words; score is P(hawkish) - P(dovish).

    The vocabulary is one of features.vocabulary, of a bounded size, and goes out with the function.
    """
    column = {term: k for k, term in enumerate(terms)}

    def logits(sentence: str) -> np.ndarray:
        counts: dict[int, int] = {}
        for gram in text.grams_of(sentence):
            if gram in column:
                counts[column[gram]] = counts.get(column[gram], 0) + 1
        if not counts:
            return bias
        at = np.fromiter(counts, int)
        x = (1 + np.log(np.fromiter(counts.values(), float))) * idf[at]
        return x / np.linalg.norm(x) @ weights[at] + bias

    @F.pandas_udf(VERDICTS)
    def verdicts(sentences: pd.Series) -> pd.Series:
        out = []
        for mine in sentences:
            rows = []
            for sentence in mine if mine is not None else ():
                z = logits(sentence)
                p = np.exp(z - z.max())
                p /= p.sum()
                rows.append({"label": classes[int(np.argmax(z))], "score": float(p[0] - p[1])})
            out.append(rows if mine is not None else None)
        return pd.Series(out, dtype=object)

    return verdicts


def aligned(sentences: Column, verdicts: Column, least: float = LEAST_ALIGNED, hits: Column | None = None) -> Column:
    """array<struct<text, label, aspect, horizon>>: verdicts beside their sentences, up to the shorter of both.

    Null, the mark of a failed scorer, where verdicts are null or none, or the shorter is under `least` of the longer.
    No sentences and no verdicts are an empty array. Aspect and horizon come from cues: `hits` has their counts for
    each sentence, in the order of CUES, where they are known already.
    """
    n, m = F.size(sentences), F.size(F.coalesce(verdicts, F.array().cast(VERDICTS)))
    shorter, longer = F.least(n, m), F.greatest(n, m)
    first = lambda x: F.slice(x, F.lit(1), shorter)
    cues = first(matching.hits(sentences, CUES) if hits is None else hits)
    zipped = F.arrays_zip(first(sentences).alias("text"), first(verdicts).alias("v"), cues.alias("hits"))
    pairs = F.transform(zipped, lambda x: F.struct(x["text"].alias("text"), x["v"]["label"].alias("label"), _aspect_of(x["hits"]).alias("aspect"), _horizon_of(x["hits"]).alias("horizon")))
    usable = verdicts.isNotNull() & (shorter >= F.lit(least) * longer) & ((m > 0) | (n == 0))
    return F.when(usable, pairs)


def counted(labelled: Column) -> dict[str, Column]:
    """hawkish, dovish, relevant, net, forward_net, tone of an array of labelled sentences; null counts as none."""
    labelled = F.coalesce(labelled, F.array().cast("array<struct<text:string,label:string,aspect:string,horizon:string>>"))
    of = lambda *tests: F.size(F.filter(labelled, lambda x: _all(t(x) for t in tests)))
    is_, ahead = (lambda label: lambda x: x["label"] == label), (lambda x: x["horizon"] == "forward")
    h, d, n = of(is_("hawkish")), of(is_("dovish")), F.size(labelled)
    forward = stance.net(of(is_("hawkish"), ahead), of(is_("dovish"), ahead), of(ahead))
    return {"hawkish": h, "dovish": d, "relevant": n, "net": stance.net(h, d, n), "forward_net": forward, "tone": stance.tone_label(h, d, n)}


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def aspects(labelled: Column) -> Column:
    """map of each aspect that occurs to the net of its sentences."""
    names = F.array_sort(F.array_distinct(F.transform(labelled, lambda x: x["aspect"])))

    def net(name: Column) -> Column:
        mine = F.filter(labelled, lambda x: x["aspect"] == name)
        count = lambda label: F.size(F.filter(mine, lambda x: x["label"] == label))
        return stance.net(count("hawkish"), count("dovish"), F.size(mine))

    return F.map_from_arrays(names, F.transform(names, net))


def assess(
    rows: DataFrame, scorer: Scorer, cross_check: Scorer, lexicon=None, terms: Sequence[str] = text.POLICY_TERMS, banks: tuple[str, ...] = CLASSIFIER_BANKS,
    key: str = "doc_id", text_col: str = "text", headline: str = "headline", bank: str = "bank",
) -> DataFrame:
    """key, headline, sentences, relevant, hawkish, dovish, net, forward_net, tone, aspects, classifier_net, lexicon_score, fired, uncertainty, needs_review, degraded.

    The headline is given and never changed. A scorer that fails on a text degrades its structured part to an
    abstention (degraded, counts of none, neutral); the cross-checks stay. The cross-check counts for `banks`
    only, the lexicon where it fired. Null texts have no sentences.
    """
    scored = (lexicon or text.lexicon())(F.col(text_col))
    sents = F.coalesce(text.sentences(F.col(text_col)), F.array().cast("array<string>"))
    found = rows.select(F.col(key).alias("key"), F.col(headline).alias("headline"), F.col(bank).alias("bank"), sents.alias("sents"), scored.alias("lexicon"))
    # the gate and all cues in one pass over the sentences
    found = found.withColumn("hits", matching.hits(F.col("sents"), CUES | {"gate": terms}))
    kept = F.filter(F.arrays_zip("sents", "hits"), lambda x: F.element_at(x["hits"], -1) > 0)
    found = found.withColumn("kept", kept).withColumn("gated", F.transform("kept", lambda x: x["sents"])).withColumn("cues", F.transform("kept", lambda x: x["hits"]))
    found = found.withColumn("verdicts", scorer(F.col("gated"))).withColumn("checked", cross_check(F.col("gated"))).withColumn("labelled", aligned(F.col("gated"), F.col("verdicts"), hits=F.col("cues")))
    said = counted(F.col("labelled"))
    of = lambda label: F.size(F.filter("checked", lambda v: v["label"] == label))
    found = found.select(
        "key", "headline", F.size("sents").alias("sentences"), *[c.alias(name) for name, c in said.items()], F.coalesce(aspects(F.col("labelled")), F.create_map().cast("map<string,double>")).alias("aspects"),
        stance.net(of("hawkish"), of("dovish"), F.size("gated")).alias("classifier_net"), F.col("lexicon.score").alias("lexicon_score"),
        (F.col("lexicon.hawkish_hits") + F.col("lexicon.dovish_hits") > 0).alias("fired"), F.coalesce(F.col("bank").isin(*banks), F.lit(False)).alias("applies"), F.col("labelled").isNull().alias("degraded"),
    )
    uncertainty, review = stance.combine(F.col("headline"), F.col("net"), F.col("classifier_net"), F.col("lexicon_score"), F.col("fired"), F.col("applies"))
    return found.withColumn("uncertainty", uncertainty).withColumn("needs_review", review).drop("applies").withColumnRenamed("key", key)


def offline_tone(rows: DataFrame, scorer: Scorer, band: float = 0.10, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, hawkish, dovish, sentences, score, tone, rationale: the balance of the sentences that take a side.

    Under the band, or without such sentences, the tone is neutral; it is never mixed. A text without sentences is
    one itself; null is empty.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    sents = text.sentences(raw)
    labels = F.transform(scorer(F.when(F.size(sents) > 0, sents).otherwise(F.array(raw))), lambda v: v["label"])
    count = lambda label: F.size(F.filter("labels", lambda x: x == label))
    found = rows.select(key, labels.alias("labels")).select(key, count("hawkish").alias("hawkish"), count("dovish").alias("dovish"), F.size("labels").alias("sentences"))
    h, d, n = F.col("hawkish"), F.col("dovish"), F.col("sentences")
    found = found.withColumn("score", stance.net(h, d, h + d))
    tone = F.when((h + d == 0) | (F.abs("score") < band), "neutral").when(F.col("score") > 0, "hawkish").otherwise("dovish")
    return found.withColumn("tone", tone).withColumn("rationale", F.format_string(RATIONALE, h, n, d, n, n - h - d, n, F.col("score")))


def offline_summary(rows: DataFrame, scorer: Scorer, most: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, summary: the first sentence and those that take sides most, `most` in all, in the order they are read in.

    Of equal scores the earlier sentence is kept. A text without sentences is its own summary, an empty one says so.
    """
    found = rows.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("raw")).withColumn("sents", text.sentences(F.col("raw"))).withColumn("verdicts", scorer(F.col("sents")))
    raw, sents = F.col("raw"), F.col("sents")
    with_scores = F.transform(F.arrays_zip(sents.alias("s"), F.col("verdicts").alias("v")), lambda x, i: F.struct((i > 0).alias("later"), (-F.round(F.abs(x["v"]["score"]), 12)).alias("weak"), i.alias("at"), x["s"].alias("sentence")))
    best = F.slice(F.array_sort(with_scores), 1, most)
    in_order = F.array_sort(F.transform(best, lambda x: F.struct(x["at"].alias("at"), x["sentence"].alias("sentence"))))
    summary = F.array_join(F.transform(in_order, lambda x: x["sentence"]), " ")
    blank = F.regexp_replace(raw, text.EDGES, "")
    return found.select(key, F.when(F.size(sents) > 0, summary).when(blank != "", blank).otherwise(NO_TEXT).alias("summary"))
