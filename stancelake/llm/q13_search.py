"""op13: the ten best documents of every benchmark item."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stancelake.llm import graph, lexical
from stancelake.llm.registry import register

K = 10

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_terms = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS t FROM documents),
s AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, g WHERE term IN (SELECT term FROM q)),
x AS (SELECT item_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN s USING (r), g GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM x JOIN s USING (r) WHERE score > 0) WHERE rank <= {K}
"""


@register("op13_search", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents is written to the shared folder, searched, and removed."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    path = f"{graph.shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    index = lexical.build(documents, path)
    found = graph.cut(lexical.search(index, benchmark, K))  # ten rows an item
    graph.remove(spark, path)
    return found
