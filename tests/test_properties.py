"""Property tests: the distributed rank-based operators against brute force on random data."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkfeat.operators import drift as D
from sparkfeat.operators.ranking import exact_quantiles

values = st.lists(st.integers(min_value=-20, max_value=20).map(float), min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(vals=values, p=st.sampled_from([0.0, 0.1, 0.33, 0.5, 0.9, 1.0]))
def test_exact_quantile_property(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [p], num_partitions=3).first()["quantile"]
    assert got == pytest.approx(float(np.percentile(vals, p * 100)))


@SETTINGS
@given(a=values, b=values)
def test_ks_statistic_property(spark, a, b):
    cur = spark.createDataFrame([(v,) for v in a], "x double")
    ref = spark.createDataFrame([(v,) for v in b], "x double")
    got = D.ks_drift(cur, ref, ["x"], num_partitions=3).first()["ks_statistic"]
    grid = sorted(set(a) | set(b))
    want = max(abs(sum(v <= g for v in a) / len(a) - sum(v <= g for v in b) / len(b)) for g in grid)
    assert got == pytest.approx(want)
