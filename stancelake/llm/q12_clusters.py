"""op12: exact clusters of all embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import centroids
from stancelake.llm.registry import register

#: Production parameters.
K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3

_PLACES = f"range(1, {SIZE + 1})"
_NEAREST = """{name} AS MATERIALIZED (SELECT r, vec_id, v, j, d FROM (SELECT r, vec_id, v, j, d, row_number() OVER (PARTITION BY r ORDER BY d, j) AS nth
  FROM (SELECT r, vec_id, v, j, list_sum(list_transform(""" + _PLACES + """, lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, {centroids})) WHERE nth = 1)"""
_MOVED = """{name} AS MATERIALIZED (SELECT c.j AS j, coalesce(m.c, c.c) AS c FROM {centroids} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(""" + _PLACES + """) AS i FROM {nearest}) GROUP BY j, i) GROUP BY j) m USING (j))"""

ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS j, v AS c FROM v QUALIFY j < {K}),
{", ".join(_NEAREST.format(name=f"a{k}", centroids=f"c{k}") + ", " + _MOVED.format(name=f"c{k + 1}", centroids=f"c{k}", nearest=f"a{k}") for k in range(ROUNDS))},
{_NEAREST.format(name="z", centroids=f"c{ROUNDS}")}
SELECT vec_id, CAST(z.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} c ON z.j = c.j
"""


def order(vec_id: Column) -> Column:
    """What the first centroids are ordered by; a null id counts as an empty one."""
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


@register("op12_clusters", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    first = centroids.seeds(vectors, K, SIZE, SCALE, order(F.col("vec_id")))
    found = centroids.fit(vectors, first, ROUNDS, SCALE)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of_cluster = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return centroids.assigned(vectors, found, SIZE, SCALE).select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(found.inertias, "bigint").alias("cluster_inertia"),
        F.lit(found.inertia).cast("bigint").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
