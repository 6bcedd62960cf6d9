"""op11: all documents without the lines that ten documents or more hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import graph, lines
from stancelake.llm.registry import register

#: Production parameters: documents that make a line frequent, code points of its key, batches that files are added in.
LEAST, LEAST_CHARS, BATCHES = 10, 1, 8

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE len(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST}),
n AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept FROM k LEFT JOIN f ON k.key = f.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM n JOIN d USING (r)
"""


def batches(documents: DataFrame, most: int) -> list[DataFrame]:
    """The rows by the files that they come from, as they would arrive; no file is read for another's batch."""
    n = min(most, max(1, len(documents.inputFiles())))
    place = F.pmod(F.crc32(F.col("_metadata.file_path").cast("binary")), F.lit(n))
    return [documents.where(place == k) for k in range(n)] if n > 1 else [documents]


@register("op11_lines", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of files are added to runs in the shared folder, then all documents are read against them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = lines.Runs(spark, f"{graph.shared_folder(spark)}/lines-{uuid.uuid4().hex}", LEAST, LEAST_CHARS)
    for batch in batches(documents, BATCHES):
        runs.add(batch)
    runs.compact()
    found = lines.strip(documents.select("doc_id", "text"), runs)
    runs.close(remove=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
