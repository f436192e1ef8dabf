"""Upserts that replace touched partitions only, and a snapshot whose entries expire."""

import datetime as dt
import os

from pyspark.sql import functions as F

from sparkfeat.operators import feature_table as FT
from sparkfeat.session import scratch_path
from sparkfeat.streaming.snapshots import snapshot_changes, snapshot_of

T0 = dt.datetime(2024, 1, 1)
ROWS = "entity_id string, feature_name string, feature_version string, value string, ts timestamp"


def rows(spark, *given):
    return spark.createDataFrame([(e, f, "1", v, T0 + dt.timedelta(hours=h)) for e, f, v, h in given], ROWS)


def files(root):
    root = root.removeprefix("file:")
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(f"{root}/data") for f in fs}


def table(spark, root, *features):
    return sorted((r.entity_id, r.feature_name, r.value) for r in FT.read_features(spark, root, list(features) or None).collect())


def test_only_touched_partitions_are_written_and_a_replay_changes_nothing(spark):
    root = scratch_path(spark, "feature-table")
    assert table(spark, root) == []
    assert FT.upsert_features(spark, root, rows(spark, ("a", "f/1", "1", 0), ("b", "f/1", "2", 0), ("a", "g", "3", 0), ("a", "g", "4", 1)), 0) == ["f/1", "g"]
    before = files(root)
    assert table(spark, root) == [("a", "f/1", "1"), ("a", "g", "4"), ("b", "f/1", "2")]
    reader = FT.read_features(spark, root)                           # opened before the next upsert
    assert FT.upsert_features(spark, root, rows(spark, ("b", "g", "5", 2), ("a", "g", "6", 0)), 1) == ["g"]
    assert before <= files(root)                                     # nothing that was there changed
    assert not any("number=1" in f and "f%2F1" in f for f, _ in files(root))
    assert table(spark, root) == [("a", "f/1", "1"), ("a", "g", "6"), ("b", "f/1", "2"), ("b", "g", "5")]
    assert table(spark, root, "f/1") == [("a", "f/1", "1"), ("b", "f/1", "2")]
    assert sorted(r.value for r in reader.collect()) == ["1", "2", "4"]
    now = files(root)
    assert FT.upsert_features(spark, root, rows(spark, ("z", "g", "9", 9)), 1) == [] and files(root) == now
    assert FT.vacuum(spark, root) == 1 and len(table(spark, root)) == 4


def test_a_write_that_was_not_published_is_not_seen(spark):
    root = scratch_path(spark, "feature-table")
    FT.upsert_features(spark, root, rows(spark, ("a", "f", "1", 0)), 0)
    rows(spark, ("a", "f", "half", 5)).withColumn("of", F.col("feature_name")).write.partitionBy("of").parquet(f"{root}/data/number=1")
    assert table(spark, root) == [("a", "f", "1")]
    FT.upsert_features(spark, root, rows(spark, ("b", "f", "2", 5)), 1)
    assert table(spark, root) == [("a", "f", "1"), ("b", "f", "2")]


def test_entries_expire_and_late_rows_do_not_revive_them(spark):
    src, out, ckpt = (scratch_path(spark, f"snap-{n}") for n in ("src", "out", "ckpt"))
    schema = "ts timestamp, id string, v string, gone boolean"

    def send(*given):
        spark.createDataFrame([(T0 + dt.timedelta(hours=h), i, v, g) for h, i, v, g in given], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        changes = snapshot_changes(stream, "ts", "set", F.col("id"), F.to_json(F.struct("v")), F.lit(0), 10 * 3600, out, ckpt,
                                   deleted=F.col("gone"), watermark="6 hours")
        told = [(r.entity_id, r.change) for r in changes.orderBy("micros", "change").collect()]
        return told, {r.entity_id: r.features for r in snapshot_of(changes).collect()}
    told, live = send((0, "a", "1", False), (1, "b", "2", False), (2, "c", "3", False), (3, "c", "3", True))
    assert live == {"a": '{"v":"1"}', "b": '{"v":"2"}'}
    # a row older than what is kept changes nothing, nor one older than a delete
    told, live = send((14, "b", "new", False), (2, "c", "old", False), (0, "b", "old", False))
    assert live == {"a": '{"v":"1"}', "b": '{"v":"new"}'}
    told, live = send((16.5, None, None, False))                       # the clock: 10.5 hours; a's life is over
    assert live == {"b": '{"v":"new"}'} and ("a", "expire") in told
    told, live = send((9.9, "a", "late", False), (40, None, None, False))
    assert live == {} and told.count(("a", "put")) == 1 and ("b", "expire") in told and ("c", "expire") not in told
