"""State of streams survives replays: it is the state store's, found again from the checkpoint."""

from sparkfeat.session import scratch_path
from sparkfeat.streaming.streams import file_stream, latest_by_key, stream_to_table


def test_latest_row_per_key_over_batches(spark):
    path, schema = scratch_path(spark, "latest-test"), "k string, t long, v double"
    for rows in ([("a", 1, 10.0), ("a", 3, 30.0), ("b", 2, 20.0)], [("a", 2, 99.0), ("c", 5, 50.0), (None, 1, 1.0)], [("b", 7, 70.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = file_stream(spark, path, schema, max_files_per_trigger=1)
    out = stream_to_table(latest_by_key(stream, ["k"], ["t"]), ["k"], "latest-test-out")
    assert {r.k: (r.t, r.v) for r in out.collect()} == {"a": (3, 30.0), "b": (7, 70.0), "c": (5, 50.0), None: (1, 1.0)}


def test_expiring_entry_sends_few_messages_to_its_store():
    from pyspark.sql import Row

    from sparkfeat.streaming.snapshots import ExpiringEntry

    class Store:
        value, timers, calls = None, set(), 0

        def getValueState(self, *_):
            return self

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.value = None

        def listTimers(self):
            self.calls += 1
            return iter(self.timers)

        def registerTimer(self, t):
            self.calls += 1
            self.timers = self.timers | {t}

        def deleteTimer(self, t):
            self.calls += 1
            self.timers = self.timers - {t}

        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    store, entry = Store(), ExpiringEntry(10_000)
    entry.init(store)
    row = lambda micros, order, text, deleted=False: Row(micros=micros, row_order=order, features=text, deleted=deleted)
    put = list(entry.handleInputRows(("set", "a"), iter([row(5, 1, "x"), row(5, 2, "y"), row(None, 9, "z")]), store))
    assert [(r.change, r.features, r.micros, r.row_order, r.expires_micros) for r in put] == [("put", "y", 5, 2, 10_005)]
    assert store.calls == 3 and store.timers == {11}
    assert not list(entry.handleInputRows(("set", "a"), iter([row(5, 1, "late")]), store)) and store.calls == 4
    gone = list(entry.handleInputRows(("set", "a"), iter([row(7_000, 0, "x", True)]), store))
    assert [(r.change, r.micros) for r in gone] == [("delete", 7_000)] and store.calls == 8 and store.timers == {17}
