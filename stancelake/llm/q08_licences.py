"""op8: licences of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import licences
from stancelake.llm.registry import register


def _oracle() -> str:
    known = ", ".join(f"('{sentence}', '{key}')" for key, sentence in licences.SENTENCES.items())
    families: dict[str, str] = {}
    for family, licence, rule in reversed(licences.RULES):
        pattern = "%" + "%".join(f"<{i}>" for i in rule) + "%"
        families[family] = f"CASE WHEN e LIKE '{pattern}' OR l LIKE '{pattern}' THEN '{licence}' ELSE {families.get(family, 'NULL')} END"
    in_order = list(dict.fromkeys(family for family, _, _ in licences.RULES))

    def reading(name: str, ends: str) -> str:
        return f"""{name} AS (
  SELECT r, list(key ORDER BY pos) AS ids FROM (
    SELECT r, unnest(regexp_split_to_array(text, '{ends}')) AS s, generate_subscripts(regexp_split_to_array(text, '{ends}'), 1) AS pos FROM d
  ) JOIN known ON known.sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY r)"""

    return f"""
WITH known(sentence, key) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{reading("a", "[.!?;:]+(?:[ \\t\\n\\x0B\\f\\r]+|$)|\\n[ \\t\\n\\x0B\\f\\r]*\\n")},
{reading("b", "[.!?;:]+(?:[ \\t\\n\\x0B\\f\\r]+|$)|\\n")},
m AS (SELECT d.doc_id, coalesce(a.ids, []) AS x, coalesce(b.ids, []) AS y,
        coalesce(list_aggregate(list_transform(a.ids, lambda i: '<' || i || '>'), 'string_agg', ''), '') AS e,
        coalesce(list_aggregate(list_transform(b.ids, lambda i: '<' || i || '>'), 'string_agg', ''), '') AS l
      FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)),
f AS (SELECT doc_id, CASE WHEN len(y) > len(x) THEN y ELSE x END AS s, list_filter([{", ".join(families[k] for k in in_order)}], lambda i: i IS NOT NULL) AS g FROM m)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, array_to_string(s, ',') AS sentences, CAST(len(g) AS INTEGER) AS n_licences, array_to_string(g, ',') AS licences FROM f
"""


@register("op8_licences", _oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licences.scan(documents).select(
        "doc_id",
        F.size("sentences").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.size("licences").alias("n_licences"),
        F.array_join("licences", ",").alias("licences"),
    )
