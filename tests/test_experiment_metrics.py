import hashlib

import pytest
from pyspark.sql import functions as F

from sparkfeat.operators import experiment as X
from sparkfeat.operators import metrics as MT


def _bucket(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2 ** 32


def test_assignment_matches_md5_bucket(spark):
    df = spark.range(200).withColumnRenamed("id", "u")
    rows = df.select("u", X.two_arm(F.col("u"), 0.3).alias("arm")).collect()
    for r in rows:
        assert r["arm"] == ("control" if _bucket(str(r["u"])) < 0.3 else "treatment")
    w = {"a": 0.2, "b": 0.5, "c": 0.3}
    rows = df.select("u", X.weighted_arm(F.col("u"), w, "e1").alias("v")).collect()
    for r in rows:
        b = _bucket(f"e1:{r['u']}")
        assert r["v"] == ("a" if b < 0.2 else "b" if b < 0.7 else "c")


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        X.validate_weights({"a": 0.5, "b": 0.4})
    X.validate_weights({"a": 0.1, "b": 0.2, "c": 0.7})


def test_ab_results_only_labelled_rows(spark):
    df = spark.createDataFrame([("v1", 1.0, 1.0), ("v1", 0.0, None), ("v1", 1.0, 0.0), ("v2", 0.0, None)],
                               "version string, p double, t double")
    res = {r["version"]: r for r in X.ab_results(df, "version", "p", "t", {"v1": 0.6, "v2": 0.4}).collect()}
    assert res["v1"]["total_predictions"] == 2 and res["v1"]["accuracy"] == 0.5
    assert res["v1"]["traffic_weight"] == 0.6
    assert res["v2"]["total_predictions"] == 0 and res["v2"]["accuracy"] == 0.0   # a configured arm without labels


def test_histogram_cumulative(spark):
    df = spark.createDataFrame([(0.005,), (0.3,), (0.3,), (7.0,), (500.0,)], "v double")
    h = {r["le"]: r["bucket_count"] for r in MT.histogram(df, [], "v").collect()}
    assert h["0.01"] == 1 and h["0.5"] == 3 and h["7.5"] == 4 and h["100.0"] == 4 and h["+Inf"] == 5


def test_alert_needs_full_duration_and_gap_resets(spark):
    hours = [0, 1, 2, 3, 4, 5, 7, 8]          # hour 6 has no data
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:10:00", 1.0) for h in hours], "ts string, lat double") \
        .withColumn("ts", F.to_timestamp("ts"))
    rule = MT.AlertRule("HighLatency", F.avg("lat"), 0.5, 5, "warning")
    st = {r["bucket"].hour: r["state"] for r in MT.alert_states(df, "ts", [rule]).collect()}
    assert [st[h] for h in range(9)] == ["pending"] * 4 + ["firing", "firing", "inactive", "pending", "pending"]


def test_health_last_rule_sets_error(spark):
    df = spark.createDataFrame([(3000.0, 95.0, 1.0, True), (100.0, 10.0, 10.0, False), (100.0, 10.0, 10.0, True)],
                               "mem double, cpu double, rate double, loaded boolean")
    status, error = MT.health_status(F.col("mem"), F.col("cpu"), F.col("rate"), F.col("loaded"))
    rows = df.select(status.alias("s"), error.alias("e")).collect()
    assert rows[0] == ("degraded", "Prediction rate below minimum expected")
    assert rows[1] == ("degraded", None)
    assert rows[2] == ("healthy", None)


def test_latency_slo_is_exact_per_window_and_label(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "ts", (F.col("value") / 100).alias("lat"), F.when(F.col("user_id") % 2 == 0, "even").alias("label"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"))
    got = {(r.window_start, r.label): r.p95 for r in MT.latency_slo(ev, "ts", ["label"], "lat").collect()}
    want = {(r.w, r.label): r.p95 for r in ev.groupBy(F.window("ts", "1 hour").start.alias("w"), "label").agg(F.percentile("lat", 0.95).alias("p95")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_arms_without_labelled_rows_are_listed(spark):
    from sparkfeat.operators import experiment as X
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, None)], "version string, p double, t double")
    rows = {r.version: r for r in X.ab_results(df, "version", "p", "t", {"a": 0.5, "b": 0.5}).collect()}
    assert rows["b"].total_predictions == 0 and rows["b"].accuracy == 0.0 and rows["b"].traffic_weight == 0.5
