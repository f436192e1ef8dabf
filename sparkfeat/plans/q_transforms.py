"""Catalogue: impute / encode / scale / derive / DAG."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import exact_sum, round6
from sparkfeat.operators.transforms import (
    DependencyManager, Encoder, FeatureGenerator, Imputer, RowFunction, Scaler,
)
from sparkfeat.plans.registry import Tables, register

_IMPUTE_FRAME = ["l_orderkey", "l_linenumber", "nullif(l_discount, 0.0) AS discount",
                 "nullif(l_tax, 0.0) AS tax", "nullif(l_returnflag, 'N') AS flag"]


@register("impute", """WITH t AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS discount,
  nullif(l_tax, 0.0) AS tax, nullif(l_returnflag, 'N') AS flag FROM lineitem),
f AS (SELECT avg(discount) AS md, quantile_cont(tax, 0.5) AS mt FROM t),
m AS (SELECT flag AS mf FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag ASC LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(discount, md), 6) AS discount,
  round(coalesce(tax, mt), 6) AS tax, coalesce(flag, mf) AS flag FROM t, f, m""", "A1 F1")
def impute(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.selectExpr(*_IMPUTE_FRAME)
    mean_fill = Imputer("mean_fill", numeric_cols=["discount"], categorical_cols=["flag"],
                        numeric_strategy="mean").fit(t)
    median_fill = Imputer("median_fill", numeric_cols=["tax"], numeric_strategy="median").fit(t)
    out = median_fill.transform(mean_fill.transform(t))
    return out.withColumns({"discount": round6(F.col("discount")), "tax": round6(F.col("tax"))})


_STATUS = ["F", "O"]                       # categories present where o_orderstatus <> 'P'
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]  # '5-LOW' nulled


def _onehot_sql():
    cols = [f"""CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS "o_orderstatus_{v}\"""" for v in _STATUS]
    cols += [f"""CASE WHEN pr = '{v}' THEN 1 ELSE 0 END AS "pr_{v}\"""" for v in _PRIORITY]
    return ("SELECT o_orderkey, " + ", ".join(cols) +
            " FROM (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS pr FROM orders)")


@register("onehot", _onehot_sql(), "A2 F2 U3 U4")
def onehot(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.selectExpr(
        "o_orderkey", "o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS pr")
    enc = Encoder("onehot", ["o_orderstatus", "pr"], method="one-hot").fit(
        o.where("o_orderstatus <> 'P'"))
    return enc.transform(o)


@register("label_encode", """WITH fit AS (
  SELECT 'o_orderstatus' AS f, o_orderstatus AS v, min(o_orderkey) AS first FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey) FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority),
idx AS (SELECT f, v, CAST(row_number() OVER (PARTITION BY f ORDER BY first, v) - 1 AS INTEGER) AS i FROM fit)
SELECT o.o_orderkey, coalesce(s.i, -1) AS o_orderstatus, coalesce(p.i, -1) AS o_orderpriority
FROM orders o LEFT JOIN idx s ON s.f = 'o_orderstatus' AND s.v = o.o_orderstatus
LEFT JOIN idx p ON p.f = 'o_orderpriority' AND p.v = o.o_orderpriority""", "A2 F2")
def label_encode(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    enc = Encoder("label", ["o_orderstatus", "o_orderpriority"], method="label",
                  order_col="o_orderkey").fit(o.where("o_orderstatus <> 'P'"))
    return enc.transform(o)


@register("label_encode_table", """WITH k AS (SELECT l_orderkey AS v, min(l_shipdate) AS first FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey),
idx AS (SELECT v, row_number() OVER (ORDER BY first, CAST(v AS VARCHAR)) - 1 AS i FROM k)
SELECT l_linenumber, coalesce(i, -1) AS label, count(*) AS n, min(l_orderkey) AS first_key FROM lineitem LEFT JOIN idx ON v = l_orderkey GROUP BY ALL""", "A2 F2")
def label_encode_table(spark, sf_dir):
    """As many categories as orders: the index is a table, made by ranges and joined. Fitted on a part of the rows, so
    that others are unseen; the labels go by the first ship date."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    enc = Encoder("orders", ["l_orderkey"], method="label", order_col="l_shipdate").fit(li.where("l_linenumber > 1"))
    out = enc.transform(li.withColumn("key", F.col("l_orderkey")))
    return out.groupBy("l_linenumber", F.col("l_orderkey").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


_SCALE_FRAME = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "CAST(1.0 AS DOUBLE) AS const_one"]
_SCALE_COLS = ["l_quantity", "l_extendedprice", "const_one"]


def _scale_sql(method):
    frame = ", ".join(_SCALE_FRAME)
    if method == "standard":
        stats = ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1.0 END AS b_{c}"
                          for c in _SCALE_COLS)
        expr = "({c} - a_{c}) / b_{c}"
    elif method == "minmax":
        stats = ", ".join(f"min({c}) AS a_{c}, CASE WHEN max({c}) > min({c}) THEN max({c}) ELSE min({c}) + 1 END AS b_{c}"
                          for c in _SCALE_COLS)
        expr = "({c} - a_{c}) / (b_{c} - a_{c})"
    else:
        stats = ", ".join(
            f"quantile_cont({c}, 0.5) AS a_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 0 "
            f"THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1.0 END AS b_{c}" for c in _SCALE_COLS)
        expr = "({c} - a_{c}) / b_{c}"
    cols = ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in _SCALE_COLS)
    return (f"WITH t AS (SELECT {frame} FROM lineitem), s AS (SELECT {stats} FROM t) "
            f"SELECT l_orderkey, l_linenumber, {cols} FROM t, s")


def _scale(spark, sf_dir, method):
    t = Tables(spark, sf_dir).lineitem.selectExpr(*_SCALE_FRAME)
    out = Scaler(f"scale_{method}", _SCALE_COLS, method=method).fit_transform(t)
    return out.withColumns({c: round6(F.col(c)) for c in _SCALE_COLS})


@register("scale_standard", _scale_sql("standard"), "A3 F3")
def scale_standard(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@register("scale_minmax", _scale_sql("minmax"), "A3 F3")
def scale_minmax(spark, sf_dir):
    return _scale(spark, sf_dir, "minmax")


@register("scale_robust", _scale_sql("robust"), "A3 F3")
def scale_robust(spark, sf_dir):
    return _scale(spark, sf_dir, "robust")


_DERIVED = {
    "revenue": "l_extendedprice * (1 - l_discount)",
    "revenue_tax": "revenue * (1 + l_tax)",
    "qty_share": "try_divide(l_quantity, l_linenumber - 1)",
    "broken": "no_such_column * 2",
}


@register("derive_features", """SELECT l_orderkey, l_linenumber,
  round(l_extendedprice * (1 - l_discount), 6) AS revenue,
  round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS revenue_tax,
  round(CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE l_quantity / (l_linenumber - 1) END, 6) AS qty_share,
  CAST(NULL AS DOUBLE) AS broken
FROM lineitem""", "F6 X2")
def derive_features(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    gen = FeatureGenerator("derive", _DERIVED)
    out = gen.transform(t)
    assert gen.failures == 1
    return out.select("l_orderkey", "l_linenumber",
                      *[round6(F.col(c)).alias(c) for c in ("revenue", "revenue_tax", "qty_share")],
                      F.col("broken").cast("double"))


def _log_of_tax(tax):
    """A user's function that raises on the whole batch for one bad value."""
    if (tax <= 0).any():
        raise ValueError("no logarithm")
    import numpy as np
    return np.log(tax)


@register("derive_failures", """SELECT 'qty_share' AS name, count(*) FILTER (WHERE l_linenumber = 1) AS failed_rows, count(*) AS n,
    round(CAST(sum(CAST(CASE WHEN l_linenumber > 1 THEN l_quantity / (l_linenumber - 1) END AS DECIMAL(28, 9))) AS DOUBLE), 3) AS total FROM lineitem
UNION ALL SELECT 'flag_number', count(*), count(*), NULL FROM lineitem
UNION ALL SELECT 'log_tax', count(*) FILTER (WHERE l_tax <= 0), count(*),
    round(CAST(sum(CAST(CASE WHEN l_tax > 0 THEN ln(l_tax) END AS DECIMAL(28, 9))) AS DOUBLE), 3) FROM lineitem""", "F6 X2")
def derive_failures(spark, sf_dir):
    """Rows on which a definition fails, counted in the pass that computes it: SQL, a callable, a function of batches."""
    t = Tables(spark, sf_dir).lineitem.select("l_linenumber", "l_quantity", "l_returnflag", "l_tax")
    gen = FeatureGenerator("derive", {"qty_share": "l_quantity / (l_linenumber - 1)",
                                      "flag_number": lambda df: F.col("l_returnflag").cast("double"),
                                      "log_tax": RowFunction(_log_of_tax, ["l_tax"])}, count_failures=True)
    sums = gen.transform(t).agg(F.count(F.lit(1)).alias("n"), *[exact_sum(F.col(c)).alias(c) for c in gen.transformations]).first()
    return spark.createDataFrame([(name, rows, sums["n"], sums[name]) for name, rows in gen.row_failures().items()],
                                 "name string, failed_rows long, n long, total double").withColumn("total", F.round("total", 3))


@register("feature_dag", """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
    coalesce(nullif(l_discount, 0.0), (SELECT avg(nullif(l_discount, 0.0)) FROM lineitem)) AS discount
  FROM lineitem),
d AS (SELECT *, l_extendedprice * (1 - discount) AS revenue FROM t),
s AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS sd FROM d)
SELECT l_orderkey, l_linenumber, round(discount, 6) AS discount, round((revenue - m) / sd, 6) AS revenue
FROM d, s""", "F7 X1")
def feature_dag(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice", "nullif(l_discount, 0.0) AS discount")
    dag = DependencyManager()
    # registered out of order on purpose: the manager must run impute → derive → scale
    dag.add_transformer(Scaler("scale", ["revenue"], dependencies=["derive"]))
    dag.add_transformer(FeatureGenerator("derive", {"revenue": "l_extendedprice * (1 - discount)"},
                                         dependencies=["impute", "not_registered"]))
    dag.add_transformer(Imputer("impute", numeric_cols=["discount"]))
    assert dag.execution_order() == ["impute", "derive", "scale"]
    out = dag.fit_transform(t)
    return out.select("l_orderkey", "l_linenumber", round6(F.col("discount")).alias("discount"),
                      round6(F.col("revenue")).alias("revenue"))
