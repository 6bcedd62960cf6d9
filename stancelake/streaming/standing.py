"""Streams: idempotent ingestion and standings that follow as readings arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import ingest, series, snapshots


def stream_ingest(rows: DataFrame, path: str, checkpoint: str, text: str = "text", order: str = "doc_id", once: bool = True, rules: dict[str, Column] | None = None, rejects: str | None = None):
    """Starts a query that appends unseen texts of each micro-batch to a table; a replayed batch adds nothing.

    Rows that break one of the `rules` go to the table `rejects` with the names of those, and the stream goes on.
    """


    def write(batch: DataFrame, _: int) -> None:
        good = batch
        if rules:
            good, bad = ingest.validated(batch, rules)
            if rejects:
                ingest.append(bad, rejects)
        ingest.ingest(good, path, batch.sparkSession, text, order)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


TABLE = "found"


def stream_table(found: DataFrame, root: str, checkpoint: str, once: bool = True):
    """Starts a query that puts the whole result of each micro-batch into a snapshot of the table under `root`.

    Readers have the last whole result until the next is complete; the driver gets no rows. A micro-batch that is run
    again adds nothing.
    """
    tables = snapshots.Tables(found.sparkSession, root)

    def write(batch: DataFrame, number: int) -> None:
        base = tables.snapshot()
        if f"epoch-{number}" in base.batches():  # published before a failure; the state has still to be made
            batch.write.format("noop").mode("overwrite").save()
        else:
            tables.replace({TABLE: batch}, f"epoch-{number}", base)

    writer = found.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_result(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """The rows that stream_table has put there last, or in a snapshot."""
    return snapshots.Tables(spark, root).read(TABLE, snapshot)


def standing(rows: DataFrame, member: str = "member", ts: str = "ts", id_col: str = "id", score: str = "score") -> DataFrame:
    """member, score, ts, readings: each member's last reading by event time, for update or complete mode.

    State is one row for each member. A late reading counts but does not replace a later one.
    """
    newest = F.max(F.struct(ts, id_col, score)).alias("newest")
    return rows.groupBy(member).agg(newest, F.count(F.lit(1)).alias("readings")).select(member, F.col(f"newest.{score}").alias("score"), F.col(f"newest.{ts}").alias("ts"), "readings")


def monthly_index(rows: DataFrame, ts: str = "ts", score: str = "score") -> DataFrame:
    """month, mean, n over a stream; months are calendar months, so they are keys and not windows."""
    return rows.groupBy(series.month_index(F.col(ts)).alias("month")).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
