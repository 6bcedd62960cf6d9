"""Standings as keyed state: late and repeated readings, what is forgotten, and a table that only changes are added to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stancelake import errors
from stancelake.operators import snapshots

#: State is kept in RocksDB, on the local disks of executors, with its changes in the checkpoint.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHANGES = "member {0}, score double, at bigint, id bigint, readings bigint, previous double"

TABLE = "standings"


class _Standing(StatefulProcessor):
    """State of a member: its newest reading, how many there were, and the ids that may still come again."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("standing", "ts bigint, id bigint, score double, readings bigint, ids array<bigint>, moments array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        # rows from before the watermark do not get here, so ids from before it cannot come again
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        frame = pd.DataFrame({"id": frame["id"].astype("int64"), "at": frame["at"].astype("int64"), "score": frame["score"].astype(float)}).drop_duplicates("id")
        if self.state.exists():
            ts, newest, score, readings, ids, moments = self.state.get()
            frame = frame[~frame["id"].isin(ids)]
        else:
            ts, newest, score, readings, ids, moments = None, None, None, 0, [], []
        if not len(frame):
            return
        before = score
        readings += len(frame)
        last = frame.sort_values(["at", "id"]).iloc[-1]
        if ts is None or (int(last["at"]), int(last["id"])) > (ts, newest):
            ts, newest, score = int(last["at"]), int(last["id"]), float(last["score"])
        ids, moments = np.concatenate([np.array(ids, np.int64), frame["id"]]), np.concatenate([np.array(moments, np.int64), frame["at"]])
        alive = moments >= watermark
        self.state.update((ts, newest, score, readings, ids[alive].tolist(), moments[alive].tolist()))
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ts // 1000 + self.forget_ms)
        yield pd.DataFrame({"member": [key[0]], "score": [score], "at": [ts], "id": [newest], "readings": [readings], "previous": [before]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        empty = pd.array([None], "Int64")
        yield pd.DataFrame({"member": [key[0]], "score": np.array([np.nan]), "at": empty, "id": empty, "readings": [0], "previous": np.array([np.nan])})

    def close(self) -> None:
        pass


def changes(rows: DataFrame, late: str = "1 day", forget_ms: int | None = None) -> DataFrame:
    """member, score, ts, id, readings, previous of each member of whom a micro-batch has something new.

    rows: a stream of member, ts, id, score. The newest reading by (ts, id) stands. A late one counts among the readings and
    does not replace a newer one; one that comes more than `late` behind the newest of all is dropped. A reading whose id came
    before counts once. Rows without member, ts or id are dropped; a null score is a reading that says nothing, so
    it is dropped as well. A member of whom nothing was heard for `forget_ms` of event time is forgotten: one row without
    score and with no readings says so. Needs STORE among the session's settings.
    """
    spark = rows.sparkSession
    name, provider = next(iter(STORE.items()))
    if spark.conf.get(name) != provider:
        raise errors.InvalidInput(f"set {name} to {provider}")
    kind = rows.schema["member"].dataType.simpleString()
    heard = rows.select("member", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"))
    heard = heard.where("member IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL AND score IS NOT NULL").withWatermark("ts", late)
    heard = heard.withColumn("at", F.unix_micros("ts"))
    found = heard.groupBy("member").transformWithStateInPandas(_Standing(forget_ms), CHANGES.format(kind), "Update", "EventTime")
    return found.select("member", "score", F.timestamp_micros("at").alias("ts"), "id", "readings", "previous")


def keep(found: DataFrame, root: str, checkpoint: str, once: bool = True, compact_every: int = 50):
    """Starts a query that adds each micro-batch's changes to the table under `root`, whose rows are never rewritten.

    A micro-batch is a batch of snapshots.Tables under its own number, so one that is run again after a failure adds
    nothing. After `compact_every` of them the table is put together into one, in a snapshot of its own.
    """
    tables = snapshots.Tables(found.sparkSession, root)

    def write(batch: DataFrame, number: int) -> None:
        try:
            tables.publish({TABLE: batch.withColumn("epoch", F.lit(number).cast("long"))}, f"epoch-{number}")
        except errors.ImmutableRecord:  # it was published before the failure; the state has still to be made
            batch.write.format("noop").mode("overwrite").save()
            return
        base = tables.snapshot()
        if len(base.tables[TABLE]) >= compact_every:
            whole = _newest(tables.read(TABLE, base.number))
            tables.replace({TABLE: whole}, f"upto-{number}", base)

    writer = found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _newest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("member").orderBy(F.desc("epoch"))  # a row for each change since the last compaction
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def standings(spark, root: str, snapshot: int | None = None) -> DataFrame:
    """member, score, ts, id, readings of all members as of a snapshot; those that are forgotten are left out."""
    return _newest(snapshots.Tables(spark, root).read(TABLE, snapshot)).where("readings > 0").select("member", "score", "ts", "id", "readings")
