"""op4: every document's bytes through a telephony media column and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import telephony
from stancelake.llm.registry import register

#: The payload is padded to a positive multiple of this.
UNIT = 576


@register("op4_telephony")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    size = F.octet_length("raw")
    padding = F.greatest(F.lit(UNIT), F.ceil(size / UNIT).cast("int") * UNIT) - size
    names = F.array(*[F.lit(c) for c in ("mulaw", "alaw", "adpcm")])
    codec = F.element_at(names, (F.pmod(F.crc32("raw"), F.lit(3)) + 1).cast("int"))
    rows = documents.select("doc_id", size.cast("bigint").alias("n_bytes"), F.concat("raw", F.unhex(F.repeat(F.lit("FF"), padding))).alias("payload"), codec.alias("codec"))
    stored = telephony.encode(rows).select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = telephony.decode(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%s:%d:%d:%d:%d:%08x", "codec", "rate", "peak", "crossings", "mean_size", F.crc32("pcm")).alias("feature"),
        F.octet_length("pcm").cast("bigint").alias("pcm_bytes"),
    )
