"""Progress of ingestion: events (batch_id, doc_id, seq, stage, processed, total, error) and what they add up to, of a table or of a stream."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STAGES = ("queued", "parsing", "chunking", "embedding", "graphing", "done", "error")


def percent(stage: Column, processed: Column, total: Column) -> Column:
    """How far a document is; embedding runs from 35 to 85."""
    return (
        F.when(stage == "parsing", 8.0)
        .when(stage == "chunking", 30.0)
        .when(stage == "embedding", 35.0 + 50.0 * processed / F.greatest(total, F.lit(1)))
        .when(stage == "graphing", 90.0)
        .when(stage == "done", 100.0)
        .otherwise(0.0)
    )


def latest(events: DataFrame) -> DataFrame:
    """The last event of each document, with its percentage."""
    last = events.groupBy("batch_id", "doc_id").agg(F.max_by(F.struct("stage", "processed", "total", "error"), "seq").alias("e"))
    return last.select("batch_id", "doc_id", "e.*").withColumn("pct", percent(F.col("stage"), F.col("processed"), F.col("total")))


def snapshot(events: DataFrame) -> DataFrame:
    """batch_id, docs, done (all ended), pct (mean, one decimal)."""
    ended = F.col("stage").isin("done", "error")
    return latest(events).groupBy("batch_id").agg(F.count("*").alias("docs"), F.bool_and(ended).alias("done"), F.round(F.avg("pct"), 1).alias("pct"))


def outcome(events: DataFrame) -> DataFrame:
    """batch_id, done_docs, error: how many documents are done; where none is, the first error."""
    each = latest(events)
    done = F.count_if(F.col("stage") == "done")
    return each.groupBy("batch_id").agg(done.alias("done_docs"), F.when(done == 0, F.min_by("error", F.when(F.col("error").isNotNull(), F.col("doc_id")))).alias("error"))


class _Fold(StatefulProcessor):
    """State of a batch: the last event of each document, by seq; events may come in any order. After each trigger the batch's documents are
    counted anew, so that what is told is what a table of the same events adds up to."""

    def __init__(self, doc_type: str, keep_ms: int | None):
        self.doc_type, self.keep_ms = doc_type, keep_ms

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", f"doc_id {self.doc_type}", "seq long, stage string, processed long, total long, error string", self.keep_ms)
        self.seen = handle.getValueState("seen", "n long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, n = {}, (self.seen.get() or (0,))[0]
        for r in rows:
            n += 1
            if r.doc_id not in newest or r.seq > newest[r.doc_id][0]:
                newest[r.doc_id] = (r.seq, r.stage, r.processed, r.total, r.error)
        self.seen.update((n,))
        for doc, value in newest.items():
            if not self.last.containsKey((doc,)) or value[0] > self.last.getValue((doc,))[0]:
                self.last.updateValue((doc,), value)
        docs, ended, done, percents, error = 0, 0, 0, 0.0, None
        for (doc,), (_, stage, processed, total, said) in sorted(self.last.iterator(), key=lambda x: x[0][0]):
            docs, ended, done = docs + 1, ended + (stage in ("done", "error")), done + (stage == "done")
            percents += {"parsing": 8.0, "chunking": 30.0, "embedding": 35.0 + 50.0 * (processed or 0) / max(total or 0, 1), "graphing": 90.0, "done": 100.0}.get(stage, 0.0)
            error = said if error is None else error
        yield Row(batch_id=key[0], docs=docs, done=ended == docs, percents=percents, done_docs=done, error=None if done else error, seen=n)

    def close(self) -> None:
        pass


def snapshots(events: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """A stream of snapshots of a stream of events: batch_id, docs, done, pct, done_docs, error as snapshot() and outcome() have them, and seen,
    the number of events so far, so that of a batch's rows the one with the most is the latest. A batch whose documents have all ended
    is done. Needs the RocksDB state store.

    keep_hours: a batch's state goes after that long without an event; by default it stays. Only for queries that run on: one that ends
    when no data are left goes on to clean up state by time, and so has no end."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"batch_id {kinds['batch_id']}, docs long, done boolean, percents double, done_docs long, error string, seen long"
    told = events.select("batch_id", "doc_id", F.col("seq").cast("long"), "stage", F.col("processed").cast("long"), F.col("total").cast("long"), F.col("error").cast("string"))
    folded = told.groupBy("batch_id").transformWithState(_Fold(kinds["doc_id"], keep_hours and int(keep_hours * 3_600_000)), out, "Update", "ProcessingTime" if keep_hours else "None")
    return folded.select("batch_id", "docs", "done", F.round(F.col("percents") / F.col("docs"), 1).alias("pct"), "done_docs", "error", "seen")


@contextlib.contextmanager
def rocksdb(spark):
    """The session with the state store that snapshots() needs, for queries started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def poll(read: Callable[[], DataFrame], batch, every: float = 0.15, most: float = 3600.0) -> Iterator[Row]:
    """Snapshots of a batch while it runs, each time one differs from the last; ends with the batch, or after `most` seconds. read: gives the table of
    events as it is then; a batch that has none yet is waited for."""
    last, until = None, time.monotonic() + most
    while time.monotonic() < until:
        now = snapshot(read().where(F.col("batch_id") == batch)).first()
        if now is not None and now != last:
            yield now
            last = now
        if now is not None and now["done"]:
            return
        time.sleep(every)
