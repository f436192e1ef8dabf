"""A serving snapshot kept by a stream, whose entries expire.

Each entity's entry is state of a stateful processor: its latest row by (event time, order) and nothing
more. An event-time timer at the row's time + ttl removes the entry and reports it; an explicit delete does so
at once and leaves a tombstone until that same time. A row whose own lifetime is over at the stream's time, or which is
older than what is kept, changes nothing: late rows cannot revive an entry, since what they are
older than is kept for as long as they could live.

The stream's time is its watermark: an entry with time t lives while t + ttl is after it, as in
``store.live``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkfeat.streaming.streams import append_batches, rocksdb

CHANGES = ("feature_set string, entity_id string, change string, features string, micros long, "
           "row_order long, expires_micros long")
_CHANGE = Row(*[c.split()[0] for c in CHANGES.split(", ")])
#: A change's rank among those of one row: its entry is put, then ends.
RANK = {"put": 0, "delete": 0, "expire": 1}


class ExpiringEntry(StatefulProcessor):
    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "micros long, row_order long, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # runs for every entity of every batch: each call to the state store is a message to the JVM and back
        now, best = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000, None
        for r in rows:
            if r.micros is not None and r.micros + self.ttl > now and (best is None or (r.micros, r.row_order) >= (best.micros, best.row_order)):
                best = r
        if best is None:
            return
        kept = self.entry.get()
        if kept and (best.micros, best.row_order) <= (kept[0], kept[1]):
            return
        self.entry.update((best.micros, best.row_order, best.deleted))
        ends = best.micros + self.ttl
        timer = self._timer(ends)
        if kept and self._timer(kept[0] + self.ttl) != timer:         # an entry has one timer, at its end
            self.handle.deleteTimer(self._timer(kept[0] + self.ttl))
        if not kept or self._timer(kept[0] + self.ttl) != timer:
            self.handle.registerTimer(timer)
        if not best.deleted:
            yield _change(key, "put", best.features, best.micros, best.row_order, ends)
        elif kept and not kept[2]:
            yield _change(key, "delete", None, best.micros, best.row_order, ends)

    @staticmethod
    def _timer(ends: int) -> int:
        """The first millisecond not before the end."""
        return -(-ends // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.entry.get()
        if not kept:
            return
        micros, order, deleted = kept
        if expiredTimerInfo.getExpiryTimeInMs() * 1000 >= micros + self.ttl:
            self.entry.clear()
            if not deleted:
                yield _change(key, "expire", None, micros, order, micros + self.ttl)

    def close(self) -> None:
        pass


def _change(key, change: str, features, micros, order, ends) -> Row:
    return _CHANGE(key[0], key[1], change, features, micros, order, ends)


def snapshot_changes(stream: DataFrame, ts: str, feature_set: str, entity: Column, features: Column, order: Column, ttl_seconds: int,
                     out: str, checkpoint: str, deleted: Column | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Drains what the stream has into the table ``out`` and returns the snapshot's changes so far: put, delete
    and expire, one row each. Rows without an event time or an entity only move the clock. ``order`` decides between rows of
    one entity and time."""
    rows = stream.withWatermark(ts, watermark).select(
        F.lit(feature_set).alias("feature_set"), entity.cast("string").alias("entity_id"), F.col(ts).alias("at"),
        features.alias("features"), F.unix_micros(F.col(ts)).alias("micros"), F.coalesce(order.cast("long"), F.lit(0)).alias("row_order"),
        F.coalesce(deleted if deleted is not None else F.lit(False), F.lit(False)).alias("deleted"))
    # rows of the clock share one key of their own, which is left out here: a filter before could be pushed below the watermark
    with rocksdb(stream.sparkSession):
        changes = rows.groupBy("feature_set", "entity_id").transformWithState(
            ExpiringEntry(ttl_seconds * 1_000_000), CHANGES, "Append", "EventTime").where("entity_id is not null")
        return append_batches(changes, out, checkpoint)


def snapshot_of(changes: DataFrame) -> DataFrame:
    """feature_set, entity_id, features, expires_at of the entries that live after all the changes."""
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    last = changes.groupBy("feature_set", "entity_id").agg(F.max_by(
        F.struct("change", "features", "expires_micros"), F.struct("micros", "row_order", rank[F.col("change")])).alias("_c"))
    return last.where("_c.change = 'put'").select("feature_set", "entity_id", F.col("_c.features").alias("features"),
                                                  F.timestamp_micros("_c.expires_micros").alias("expires_at"))
