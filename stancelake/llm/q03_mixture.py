"""op3: a mixture of all documents to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import mixture
from stancelake.llm.registry import register

#: Production parameters: six tenths of all tokens, at most two epochs of a source.
SHARE, EPOCHS, SEED = (6, 10), 2, 1
WEIGHTS = {"web": 5, "books": 3, "forum": 2} | {f"{d}/{lang}": w for d in ("web", "books", "forum") for lang, w in (("en", 4), ("fr", 3), ("de", 3), ("es", 3))}

#: The domain of a source, by its hash.
DOMAIN = "CASE WHEN md5(coalesce(source, '')) < '55' THEN 'web' WHEN md5(coalesce(source, '')) < 'aa' THEN 'books' ELSE 'forum' END"


def _level(name: str, rows: str, family: str, node: str, path: str) -> str:
    """SQL of one level: the rows of a family share its budget by water-filling."""
    weight = "CASE " + " ".join(f"WHEN {path} = '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " ELSE 1 END"
    over = f"PARTITION BY {family}" if family else ""
    mine = f"PARTITION BY {family}, is_full" if family else "PARTITION BY is_full"
    return f"""
{name}_w AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM ({rows})),
{name}_s AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here_on FROM {name}_w WINDOW o AS ({over} ORDER BY CAST(cap AS DOUBLE) / w, {node})),
{name}_f AS (SELECT *, cap * here_on <= w * (up - bef) AS is_full FROM {name}_s),
{name}_l AS (SELECT *, up - coalesce(sum(cap) FILTER (is_full) OVER ({over}), 0) AS rest_up, coalesce(sum(w) FILTER (NOT is_full) OVER ({over}), 1) AS shares FROM {name}_f),
{name}_a AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w * rest_up) // shares END AS share FROM {name}_l),
{name}_r AS (SELECT *, rest_up - coalesce(sum(share) FILTER (NOT is_full) OVER ({over}), 0) AS spare, row_number() OVER ({mine} ORDER BY {node}) AS rk FROM {name}_a),
{name} AS (SELECT *, share + CASE WHEN NOT is_full AND rk <= spare THEN 1 ELSE 0 END AS budget FROM {name}_r)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL),
total AS (SELECT least((sum(tokens) * {SHARE[0]}) // {SHARE[1]}, sum(cap)) AS up FROM leaf),
{_level("a", "SELECT domain, sum(cap) AS cap, any_value(up) AS up FROM leaf, total GROUP BY domain", "", "domain", "domain")},
{_level("b", "SELECT leaf.domain, leaf.lang, sum(leaf.cap) AS cap, any_value(a.budget) AS up FROM leaf JOIN a USING (domain) GROUP BY ALL", "domain", "lang", "domain || '/' || lang")},
{_level("c", "SELECT leaf.*, b.budget AS up FROM leaf JOIN b USING (domain, lang)", "domain, lang", "source", "domain || '/' || lang || '/' || source")},
p AS (SELECT domain, lang, source, budget // greatest(tokens, 1) AS epochs, budget % greatest(tokens, 1) AS rest FROM c),
k AS (SELECT d.*, epochs, rest, md5('{SEED}/' || CAST(epochs AS BIGINT) || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d JOIN p USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
t AS (SELECT *, CAST(greatest(0, least(n_tokens, rest - start)) AS BIGINT) AS prefix_tokens FROM s)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, prefix_tokens, CAST(epochs * n_tokens + prefix_tokens AS BIGINT) AS taken_tokens FROM t
"""


def mixed(documents: DataFrame) -> DataFrame:
    return mixture.mix(documents, F.expr(DOMAIN), WEIGHTS, SHARE, EPOCHS, SEED)


@register("op3_mixture", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
