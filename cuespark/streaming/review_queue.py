"""The review queue as a stream of events, with its entries in state (an extension; the batch form is ``queue_of``).

Events are rows (id, ord, kind, entry, status): an ``append`` brings an entry, a ``status``
changes it.  Of an id's appends the first by ``ord`` is the entry, of its changes the last
one is its status, and without any it waits.  Both are kept with their ``ord``, so that
batches may be cut anywhere, events may come late or twice, and the queue is the same;
a change may even come before its entry.

State is held by ``transformWithState``, one value an id, in RocksDB and the checkpoint, and
can be read with the state data source.  Each task combines the events of an id before
they move, so that an id with very many events reaches its state as a row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuespark.dist import ship

EVENTS = "id string, ord long, kind string, entry string, status string"
#: What is known of an id: its entry and its last change, each with the ord it came with.
KNOWN = "entry string, entry_ord long, status string, status_ord long"
QUEUE = "id string, entry string, status string"
WAITING = "pending_review"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def queue_of(events: DataFrame) -> DataFrame:
    """id, entry, status of all events at once."""
    append, change = F.col("kind") == "append", (F.col("kind") == "status") & F.col("status").isNotNull()
    told = events.where("id IS NOT NULL AND ord IS NOT NULL").groupBy("id").agg(
        F.min(F.when(append, F.struct("ord", F.coalesce("entry", F.lit("")).alias("entry")))).alias("e"), F.max(F.when(change, F.struct("ord", "status"))).alias("s")
    )
    return told.where("e IS NOT NULL").select("id", F.col("e.entry").alias("entry"), F.coalesce("s.status", F.lit(WAITING)).alias("status"))


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Of two things known of an id (entry, entry_ord, status, status_ord), what is known of it."""
    if a is None:
        return b
    entry = min((x for x in ((a[1], a[0]), (b[1], b[0])) if x[0] is not None), default=(None, None))
    status = max((x for x in ((a[3], a[2]), (b[3], b[2])) if x[0] is not None), default=(None, None))
    return entry[1], entry[0], status[1], status[0]


def _told(events: pd.DataFrame) -> dict[str, tuple]:
    known: dict[str, tuple] = {}
    for id_, at, kind, entry, status in events[["id", "ord", "kind", "entry", "status"]].itertuples(index=False):
        if id_ is None or pd.isna(at):
            continue
        if kind == "append":
            known[id_] = _merged(known.get(id_), (entry or "", int(at), None, None))
        elif kind == "status" and status is not None:
            known[id_] = _merged(known.get(id_), (None, None, status, int(at)))
    return known


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for events in batches:
        rows = [(i, *k) for i, k in _told(events).items()]
        yield pd.DataFrame(rows, columns=["id", "entry", "entry_ord", "status", "status_ord"]).astype({"entry_ord": "Int64", "status_ord": "Int64"})


def _values(row) -> tuple:
    return tuple(None if pd.isna(x) else x for x in row)


class QueueState(StatefulProcessor):
    """Keeps what is known of an id and tells its entry when that has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = _values(self.known.get()) if self.known.exists() else None
        now = before
        for part in rows:
            for row in part[["entry", "entry_ord", "status", "status_ord"]].itertuples(index=False):
                now = _merged(now, _values(row))
        if now is not None and now != before:
            self.known.update(tuple(None if x is None else int(x) if k in (1, 3) else x for k, x in enumerate(now)))
            if now[1] is not None:
                yield pd.DataFrame([(key[0], now[0], now[2] or WAITING)], columns=["id", "entry", "status"])

    def close(self) -> None:
        pass


def updates(events: DataFrame) -> DataFrame:
    """id, entry, status of entries as a stream of events changes them."""
    known = events.select("id", "ord", "kind", "entry", "status").mapInPandas(_combined, "id string, " + KNOWN)
    return known.groupBy("id").transformWithStateInPandas(QueueState(), QUEUE, "Update", "None")


def take_files(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Bring the queue up to date with the event files (Parquet) that have come since the last call."""
    ship(spark)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        updates(spark.readStream.schema(EVENTS).parquet(path)).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def queue(spark: SparkSession, checkpoint: str) -> DataFrame:
    """id, entry, status of the whole queue, read from the state."""
    held = spark.read.format("statestore").option("stateVarName", "known").load(checkpoint)
    return held.where("value.entry_ord IS NOT NULL").select(F.col("key.id").alias("id"), F.col("value.entry").alias("entry"), F.coalesce("value.status", F.lit(WAITING)).alias("status"))
