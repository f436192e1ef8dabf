import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfeat.operators.ranking import exact_quantiles, keyed_quantiles, running_totals
from sparkfeat.operators.transforms import fit_quantiles


def test_running_totals_match_cumsum_across_partitions(spark):
    rnd = random.Random(11)
    rows = [(k, float(v), rnd.randint(1, 5)) for k in ("a", "b") for v in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = {(r.k, r.v): r.cum_n for r in running_totals(df, ["k"], ["v"], ["n"], num_partitions=7).collect()}
    for k in ("a", "b"):
        acc = 0
        for _, v, n in sorted(x for x in rows if x[0] == k):
            acc += n
            assert got[(k, v)] == acc


@pytest.mark.parametrize("n", [1, 2, 10, 1000])
def test_exact_quantiles_match_numpy_linear(spark, n):
    rnd = random.Random(n)
    vals = [float(rnd.randint(0, 40)) + (0.5 if i % 3 == 0 else 0.0) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.p: r.quantile for r in exact_quantiles(df, ["x"], probs, num_partitions=5).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)))


def test_approximate_quantiles_are_close(spark):
    df = spark.range(501).select((F.col("id") * 7 % 101).cast("double").alias("x"))
    d = fit_quantiles(df, ["x"], [0.25, 0.5, 0.75])
    a = fit_quantiles(df, ["x"], [0.25, 0.5, 0.75], "approx")
    assert all(abs(x - y) <= 2 for x, y in zip(a["x"], d["x"]))


def test_nan_null_keys_and_text(spark):
    df = spark.createDataFrame([(None, "1"), (None, "NaN"), (None, "abc"), (None, "3"), ("k", "2"), ("k", None), (None, "2")], "k string, v string")
    got = {r.k: r.quantile for r in keyed_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "k": 2.0}
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 1, 1)], "k string, o int, v int")
    assert sorted((r.k or "", r.o, r.cum_v) for r in running_totals(rows, ["k"], ["o"], ["v"]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_weights_count_as_rows(spark):
    df = spark.createDataFrame([("k", 1.0, 3), ("k", 10.0, 1)], "k string, v double, n long")
    assert keyed_quantiles(df, ["k"], "v", [1.0, 0.5], weight="n").where("p = 0.5").first().quantile == 1.0
