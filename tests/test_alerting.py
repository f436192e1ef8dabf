"""Look-back alert rules on hand-made series, and the streaming state machine on silence and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkfeat.operators import alerting as AL

T0 = dt.datetime(2024, 1, 1, 10, 0)


def log(spark, rows):
    """rows: (minute, label, latency)"""
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m, seconds=7), e, x) for m, e, x in rows], "ts timestamp, endpoint string, latency double")


def rule(for_steps=3, threshold=0.5):
    return [AL.mean_rule("Slow", F.col("latency"), threshold, for_steps, "warning", ["endpoint"])]


def states(df, endpoint):
    rows = df.where(F.col("labels") == f"endpoint={endpoint}").orderBy("bucket").collect()
    return [(int((r.bucket - T0).total_seconds() // 60), r.value, r.state) for r in rows]


def test_a_sparse_series_keeps_its_value_for_five_minutes(spark):
    df = log(spark, [(0, "a", 0.9), (9, "b", 0.1)])
    got = states(AL.lookback_states(df, "ts", rule()), "a")
    assert [s for _, _, s in got] == ["pending", "pending", "firing", "firing", "firing"] + ["inactive"] * 5
    assert [v for _, v, _ in got] == [0.9] * 5 + [None] * 5
    changes = AL.alert_changes(df, "ts", rule()).orderBy("bucket").collect()
    assert [(r.previous, r.state, r.bucket.minute) for r in changes] == [("inactive", "pending", 0), ("pending", "firing", 2), ("firing", "inactive", 5)]


def test_means_are_of_the_look_back_and_exact_in_any_order(spark):
    rows = [(0, "a", 0.1), (0, "a", 0.2), (1, "a", 0.9), (6, "a", 0.6), (7, "a", None), (3, None, 0.7)]
    for order in (rows, rows[::-1]):
        got = dict((m, v) for m, v, _ in states(AL.lookback_states(log(spark, order), "ts", rule()), "a"))
        assert got[0] == pytest.approx(0.15) and got[4] == pytest.approx(0.4) and got[5] == 0.9
        assert got[6] == 0.6 and got[7] == 0.6                       # a null latency counts for nothing
    assert [m for m, v, _ in states(AL.lookback_states(log(spark, rows), "ts", rule()), "") if v] == [3, 4, 5, 6, 7]


def test_a_gauge_keeps_its_latest_reading_and_a_gap_resets_a_run(spark):
    gauge = [AL.last_rule("High", F.col("latency"), 0.5, 2, "critical", ["endpoint"])]
    df = log(spark, [(0, "a", 0.9), (0, "a", 0.95), (2, "a", 0.2), (3, "a", 0.8), (20, "a", 0.9)])
    got = states(AL.lookback_states(df, "ts", gauge), "a")
    assert [s for _, _, s in got[:9]] == ["pending", "firing", "inactive", "pending", "firing", "firing", "firing", "firing", "inactive"]
    assert got[-1][2] == "pending"


def test_dense_states_change_where_changes_say(spark):
    df = log(spark, [(m, e, (m * 7 % 5) / 4) for m in (0, 1, 2, 5, 9, 10, 11, 30, 31, 37) for e in "ab"])
    dense = AL.lookback_states(df, "ts", rule(2)).collect()
    want, before = set(), {}
    for r in sorted(dense, key=lambda r: (r.labels, r.bucket)):
        was = before.get(r.labels, "inactive")
        if was != r.state:
            want.add((r.labels, r.bucket, was, r.state))
        before[r.labels] = r.state
    got = {(r.labels, r.bucket, r.previous, r.state) for r in AL.alert_changes(df, "ts", rule(2)).collect()}
    assert got == want and want


def test_empty_log(spark):
    df = log(spark, [(0, "a", 1.0)]).where("1 = 0")
    assert AL.lookback_states(df, "ts", rule()).count() == 0
    assert AL.alert_changes(df, "ts", rule()).count() == 0
    with pytest.raises(ValueError):
        AL.lookback_states(df, "ts", rule(), step="2 minutes", lookback="5 minutes")
