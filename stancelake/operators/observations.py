"""The register of tone observations: recorded in batches that cannot be changed, listed by speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake import errors
from stancelake.functions import rules
from stancelake.functions.text import sha256
from stancelake.operators import ingest, scan, snapshots

TABLE = "observations"


class Register:
    """Observations under a root folder, about speakers of a table with an id."""

    def __init__(self, spark: SparkSession, root: str, speakers: DataFrame, id_col: str = "id"):
        self.tables, self.known = snapshots.Tables(spark, root), speakers.select(F.col(id_col).alias("speaker_id")).where("speaker_id IS NOT NULL").distinct()

    def prepared(self, rows: DataFrame, now: Column | None = None, lexicon_score: Column | None = None, needs_review: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(observations, rejected) of rows (id, speaker_id, tone, score, source_text, observed_at).

        Of the source only its hash is kept. Where no time is given it is `now`, the current time if none. Rejected rows
        have the names of the rules that they break; an unknown speaker breaks `speaker_id`. A null source has no hash, and
        is rejected.
        """
        made = rows.select(
            "id", "speaker_id", F.coalesce("observed_at", F.current_timestamp() if now is None else now).alias("observed_at"), "tone", F.col("score").cast("double").alias("score"),
            sha256(F.col("source_text")).alias("source_sha256"), (F.lit(0.0) if lexicon_score is None else lexicon_score).alias("lexicon_score"), (F.lit(False) if needs_review is None else needs_review).alias("needs_review"),
        )
        there = self.known.withColumn("known", F.lit(True))
        checked = made.join(there, "speaker_id", "left")
        good, bad = ingest.validated(checked, rules.observation() | {"speaker_id": F.col("known")})
        columns = made.columns
        return good.select(*columns), bad.select(*columns, "reasons")

    def record(self, rows: DataFrame, batch: str, **how) -> DataFrame:
        """Publishes the observations of a batch; gives back what was rejected. A batch is recorded once: ImmutableRecord."""
        good, bad = self.prepared(rows, **how)
        self.tables.publish({TABLE: good}, batch)
        return bad

    def all(self, snapshot: int | None = None) -> DataFrame:
        return self.tables.read(TABLE, snapshot)

    def of_speaker(self, speaker: object, snapshot: int | None = None) -> DataFrame:
        """A speaker's observations, oldest first, of one instant by id. An unknown speaker is EntityNotFound; one without any has no rows."""
        if self.known.where(F.col("speaker_id") == F.lit(speaker)).isEmpty():
            raise errors.EntityNotFound("Speaker", speaker)
        return self.all(snapshot).where(F.col("speaker_id") == F.lit(speaker)).orderBy("observed_at", "id")

    def numbered(self, snapshot: int | None = None) -> DataFrame:
        """All observations with their place among those of their speaker, oldest first."""
        return scan.numbered(self.all(snapshot), ["speaker_id"], [F.col("observed_at"), F.col("id")])


def scored(speeches: DataFrame, stances: DataFrame, key: str = "speech_id", *fields: str) -> DataFrame:
    """Speeches that have a stance, with `fields` of it: an inner join. Of several stances of a speech any would be a row, so keys are distinct."""
    return speeches.join(stances.select(key, *fields), key)
