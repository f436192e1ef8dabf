import math
import random

import pytest
from pyspark.sql import functions as F

from sparkfeat.operators import drift as D

SF_CHECK = "/root/testdata/sf0.01"


def _ks(a, b):
    xs = sorted(set(a) | set(b))
    best = 0.0
    for x in xs:
        fa = sum(1 for v in a if v <= x) / len(a)
        fb = sum(1 for v in b if v <= x) / len(b)
        best = max(best, abs(fa - fb))
    return best


def _p(d, n, m):
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:
        return 1.0
    s = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, s))


def test_ks_matches_bruteforce_with_ties_and_nulls(spark):
    rnd = random.Random(3)
    a = [float(rnd.randint(0, 30)) for _ in range(300)]
    b = [float(rnd.randint(5, 40)) for _ in range(200)]
    cur = spark.createDataFrame([(v,) for v in a] + [(None,), (float("nan"),)], "x double")
    ref = spark.createDataFrame([(v,) for v in b], "x double")
    r = D.ks_drift(cur, ref, ["x"], method="asymptotic").first()
    assert r["ks_statistic"] == pytest.approx(_ks(a, b))
    assert r["p_value"] == pytest.approx(_p(r["ks_statistic"], 300, 200))
    assert r["n_current"] == 300 and r["drifted"] == (r["p_value"] < 0.05)


def test_identical_samples_no_drift(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    r = D.ks_drift(df, df, ["x"]).first()
    assert r["ks_statistic"] == 0.0 and r["p_value"] == 1.0 and r["drifted"] is False


def test_events_value_statistic(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    split = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    r = D.ks_drift(ev.where(split).select("value"), ev.where(~split).select("value")).first()
    assert r["ks_statistic"] == pytest.approx(0.012955916603249462)


def test_ks_over_time_equals_two_sample_ks_per_step(spark):
    rnd = random.Random(9)
    rows = [(f"2024-01-0{d} {h:02d}:00:00", float(rnd.randint(0, 25) + d)) for d in (1, 2, 3) for h in range(12)
            for _ in range(3)]
    df = spark.createDataFrame(rows, "ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    ref = df.where("ts < TIMESTAMP '2024-01-02 00:00:00'")
    cur = df.where("ts >= TIMESTAMP '2024-01-02 00:00:00'")
    got = D.ks_over_time(cur, "ts", ["x"], ref, "1 day").collect()
    ref_vals = [r.x for r in ref.collect()]
    for r in got:
        day_vals = [x.x for x in cur.where(F.date_trunc("day", "ts") == F.lit(r.bucket)).collect()]
        assert r.ks_statistic == pytest.approx(_ks(day_vals, ref_vals))
        assert r.n_current == len(day_vals) and r.n_reference == len(ref_vals)


def test_exact_p_value_counts_paths():
    from itertools import combinations

    from sparkfeat.operators.drift import exact_p_value
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6)):
        gaps = []
        for ups in combinations(range(n + m), n):
            i = j = worst = 0
            for s in range(n + m):
                i, j = (i + 1, j) if s in ups else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            gaps.append(worst)
        for gap in range(n * m + 1):
            assert abs(exact_p_value(gap, n, m) - sum(g >= gap for g in gaps) / len(gaps)) < 1e-12
    assert abs(exact_p_value(600 * 20, 1000, 1000) / exact_p_value(600 * 20, 1000, 1000) - 1) < 1e-12
    assert 0 < exact_p_value(300 * 300, 300, 300) < 1e-170                # 2 / C(600, 300): small values keep their digits


def test_small_samples_get_the_exact_value(spark):
    from sparkfeat.operators.drift import exact_p_value, ks_drift
    cur = spark.createDataFrame([(float(i),) for i in range(6)], "x double")
    ref = spark.createDataFrame([(float(i) + 3,) for i in range(8)], "x double")
    r = ks_drift(cur, ref).first()
    assert abs(r.ks_statistic - 0.625) < 1e-12 and abs(r.p_value - exact_p_value(30, 6, 8)) < 1e-12
    far = ks_drift(cur, ref, exact_rows=5).first()
    assert far.p_value == ks_drift(cur, ref, method="asymptotic").first().p_value != r.p_value
    with pytest.raises(ValueError):
        ks_drift(cur, ref, method="other")
