import datetime as dt
import random

import pytest

from sparkfeat.operators import experiment as X
from sparkfeat.operators.asof import as_of

T0 = dt.datetime(2024, 1, 1)


def test_as_of_equals_a_plain_search(spark):
    rng = random.Random(1)
    events = [(i, rng.choice("ab"), T0 + dt.timedelta(minutes=rng.choice([rng.randrange(0, 20_000), 5000]))) for i in range(300)] + [(900, "a", None), (901, "c", T0)]
    history = [(k, T0 + dt.timedelta(minutes=m), f"{k}{m}") for k in "ab" for m in rng.sample(range(1000, 19_000), 6)] + [("a", T0 + dt.timedelta(minutes=5000), "tie")]
    left = spark.createDataFrame(events, "i int, k string, t timestamp").repartition(3)
    right = spark.createDataFrame(history, "k string, since timestamp, name string")
    got = {r.i: r.name for r in as_of(left, "t", right, "since", ["name"], by=["k"], bucket_seconds=3600, salts=3).collect()}
    want = {i: next((n for key, s, n in sorted(history, key=lambda h: h[1], reverse=True) if key == k and t and s <= t), None) for i, k, t in events}
    assert got == want and len(set(want.values())) > 8
    assert as_of(left.where("1 = 0"), "t", right, "since", ["name"], by=["k"]).count() == 0
    assert {r.name for r in as_of(left, "t", right.where("1 = 0"), "since", ["name"], by=["k"]).collect()} == {None}


def test_a_re_weighting_holds_from_its_time_on(spark):
    events = spark.createDataFrame([(u, T0 + dt.timedelta(days=d)) for u in range(200) for d in (0, 1, 2)], "user int, ts timestamp")
    history = X.weight_history(spark, [("one", "2024-01-02", {"x": 1.0, "y": 0.0}), ("two", "2024-01-03", {"x": 0.5, "y": 0.5})])
    rows = X.assign_by_epoch(events, "user", "ts", history).collect()
    assert {(r.epoch, r.arm) for r in rows} == {(None, None), ("one", "x"), ("two", "x"), ("two", "y")}
    share = [r.arm for r in rows if r.epoch == "two"].count("x") / 200
    assert 0.35 < share < 0.65
    same = events.where("ts >= '2024-01-03'").select("user", X.weighted_arm(X.F.col("user"), {"x": 0.5, "y": 0.5}, "two").alias("arm"))
    assert {(r.user, r.arm) for r in same.collect()} == {(r.user, r.arm) for r in rows if r.epoch == "two"}
    with pytest.raises(ValueError):
        X.weight_history(spark, [("bad", "2024-01-02", {"x": 0.7})])
