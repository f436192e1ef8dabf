"""Order across ranges, combinations, divergence, ``mostly``, and no Expand for distinct counts."""

import math
import random

import pytest

from sparkfeat.operators import expectations as X
from sparkfeat.operators.expectations import ExpectationSuite


def result(suite, df):
    return [(r.success, r.observed, r.unexpected_count, r.error) for r in suite.validate(df).collect()]


def test_order_breaks_equal_a_plain_pass(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(6)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    seen = [v for _, v in rows if v is not None]
    for falling in (False, True):
        for strictly in (False, True):
            ok = {(False, False): lambda a, b: b >= a, (False, True): lambda a, b: b > a, (True, False): lambda a, b: b <= a, (True, True): lambda a, b: b < a}[falling, strictly]
            assert X.order_breaks(df, "v", ["i"], falling, strictly) == (sum(not ok(a, b) for a, b in zip(seen, seen[1:])), len(seen))
    assert X.order_breaks(df.where("v is null"), "v", ["i"]) == (0, 0)
    assert X.order_breaks(spark.createDataFrame([(i, f"{i:04}") for i in range(200)], "i int, v string"), "v", ["i"], strictly=True) == (0, 200)


def test_mostly_is_a_share_of_the_values_looked_at(spark):
    df = spark.createDataFrame([(i if i < 20 else None, i) for i in range(25)], "a int, b int")
    s = ExpectationSuite().add("a", "column_values_to_be_between", max_value=18, mostly=0.95).add("a", "column_values_to_be_between", max_value=17, mostly=0.95)
    s.add("a", "column_values_to_not_be_null", mostly=0.8).add("a", "column_values_to_not_be_null", mostly=0.81).add("a", "column_values_to_be_null", mostly=2)
    s.add("a", "column_values_to_be_unique", mostly=0.5).add("_dataframe_", "column_pair_values_to_be_equal", column_A="a", column_B="b", mostly=0.8)
    got = result(s, df)
    assert [g[0] for g in got] == [True, False, True, False, False, True, True] and got[4][3]
    none = result(ExpectationSuite().add("a", "column_values_to_be_between", max_value=0, mostly=0.9), df.where("a is null"))
    assert none == [(True, 0.0, 0, None)]


def test_compound_distinct_and_divergence(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (None, None), (None, None), (2, "y")], "a int, b string")
    assert X.compound_repeats(df, ["a", "b"]) == (4, 5)
    assert X.distinct_counts(df, ["a", "b"])["a"] | {"top": None} == {"c": "a", "distinct": 2, "rows": 5, "again": 4, "top": None}
    assert X.bin_counts(df, "a", {"bins": [0, 1, 2]}) == [0, 5, 0]
    assert X.divergence([1, 3], [0.5, 0.5, ][:1], 0.5) == pytest.approx(0.25 * math.log(0.5) + 0.75 * math.log(1.5))
    assert X.divergence([1, 1], [1.0], 0.0) is None and X.divergence([0, 0], [1.0]) == 0.0
    with pytest.raises(ValueError):
        X.divergence([1, 0], [0.7])
    s = ExpectationSuite().add("b", "column_most_common_value_to_be_in_set", value_set=["x"]).add("b", "column_kl_divergence_to_be_less_than", values=["x", "y"], weights=[0.6, 0.5], threshold=1)
    got = result(s, df)
    assert got[0][0] and not got[1][0] and "sum to 1" in got[1][3]


def test_distinct_counts_have_no_expand(spark):
    df = spark.range(100).selectExpr("id AS a", "id % 7 AS b")
    plans = []
    inner = df.select(X.F.inline(X.F.array(*[X.F.struct(X.F.lit(c).alias("c"), X.F.col(c).cast("string").alias("v")) for c in "ab"])))
    plans.append(inner.groupBy("c", "v").count()._jdf.queryExecution().executedPlan().toString())
    assert "Expand" not in plans[0] and X.distinct_counts(df, ["a", "b"])["b"]["distinct"] == 7
