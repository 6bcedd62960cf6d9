"""op7: which words of every document lie in a window of a benchmark text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import decontaminate
from stancelake.llm.registry import register

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_low = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"

ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_low('text')} AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_low('text')} AS t FROM benchmark),
c AS (SELECT item, t, least(10, len(t)) AS k FROM b WHERE len(t) > 0),
p AS (SELECT DISTINCT item, k, array_to_string(t[i:i + k - 1], ' ') AS g FROM (SELECT item, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM c)),
z AS (SELECT DISTINCT k FROM p),
d AS (SELECT r, k, i, array_to_string(t[i:i + k - 1], ' ') AS g FROM (SELECT r, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w, z)),
h AS (SELECT r, item, i, p.k AS k FROM d JOIN p ON d.k = p.k AND d.g = p.g),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


@register("op7_decontamination", ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["words"])
    return decontaminate.scan(documents, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
