"""Plan-shape guards: the properties the operators rely on at scale."""

import contextlib
import io

from pyspark.sql import functions as F

from sparkfeat.operators import quality as Q
from sparkfeat.operators import store as S
from sparkfeat.session import sizing_conf

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_latest_value_is_partially_aggregated_map_side(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = ev.select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("feature_name"),
                     F.lit("1").alias("feature_version"), F.col("value").cast("string").alias("value"), "ts")
    plan = _plan(S.latest_values(rows))
    assert "partial_max_by" in plan          # combined before the shuffle: a hot key is one row per task


def test_top_k_is_limited_before_the_shuffle(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    plan = _plan(Q.top_values(Q.value_counts(o, ["o_orderpriority", "o_orderstatus"]), 5))
    head = plan.split("\n\n")[0]
    assert head.count("WindowGroupLimit") == 2   # partial (map side) and final


def test_scan_prunes_columns_and_pushes_filters(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    df = Q.rule_pass_rates(li.where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'"),
                           {"q": "l_quantity >= 10"})
    plan = _plan(df)
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_no_python_stages_in_operators(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    from sparkfeat.operators import metrics as MT
    plan = _plan(MT.event_rate(ev, "ts", ["event_type"]))
    assert "Python" not in plan and "ArrowEval" not in plan


def test_sizing_conf_scales_with_input():
    small = sizing_conf(10 * 1024 ** 3)
    big = sizing_conf(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert sizing_conf(512 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "2048"


def test_value_counts_are_read_once(spark):
    from sparkfeat.operators import quality as Q

    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for df in (Q.categorical_profile(o, ["o_orderstatus"]), Q.boolean_quality(o.selectExpr("o_totalprice > 5 AS b"), ["b"])):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Scan parquet") - plan.count("ReusedExchange") <= 1 or plan.count("ReusedExchange") >= 1
