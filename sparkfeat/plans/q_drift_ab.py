"""Catalogue: KS drift (A14) and A/B experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import hash_unit, round6
from sparkfeat.operators import drift as D
from sparkfeat.operators import experiment as X
from sparkfeat.plans.registry import Tables, register


def _ks_sql(table, cols, cond_cur):
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CASE WHEN {cond_cur} THEN 1 ELSE 0 END AS side FROM {table} WHERE {c} IS NOT NULL"
        for c in cols)
    return f"""WITH u AS ({unions}),
g AS (SELECT feature, value, count(*) FILTER (WHERE side = 1) AS n_cur, count(*) FILTER (WHERE side = 0) AS n_ref FROM u GROUP BY feature, value),
c AS (SELECT *, sum(n_cur) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
             sum(n_ref) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
             sum(n_cur) OVER (PARTITION BY feature) AS n, sum(n_ref) OVER (PARTITION BY feature) AS m FROM g),
d AS (SELECT feature, max(abs(cc / n - cr / m)) AS ks, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM c GROUP BY feature),
p AS (SELECT *, ks * sqrt(n * m / (n + m)) AS lam FROM d),
q AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
  list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam)))))
  END AS pv FROM p)
SELECT feature, round(ks, 6) AS ks_statistic, round(pv, 6) AS p_value, pv < 0.05 AS drifted, ks > 0.3 AS statistic_alert,
  n AS n_current, m AS n_reference FROM q"""


def _rounded(df):
    return df.withColumns({"ks_statistic": round6(F.col("ks_statistic")),
                           "p_value": round6(F.col("p_value"))})


@register("drift_ks", _ks_sql("events", ["value", "user_id"], "ts >= TIMESTAMP '2024-01-16'"), "A14")
def drift_ks(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    split = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    cur = ev.where(split).select("value", "user_id")
    ref = ev.where(~split).select("value", "user_id")
    return _rounded(D.ks_drift(cur, ref, method="asymptotic"))


_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("drift_ks_lineitem", _ks_sql("lineitem", _LI_COLS, "l_shipdate >= TIMESTAMP '1998-01-01'"), "A14")
def drift_ks_lineitem(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    split = F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return _rounded(D.ks_drift(li.where(split).select(*_LI_COLS), li.where(~split).select(*_LI_COLS),
                                method="asymptotic"))


def _exact_sql():
    """Path shares by a recursive query: q lists the chances on one anti-diagonal of the grid."""
    head = _ks_sql("events", _EXACT_COLS, "ts >= TIMESTAMP '2024-01-02'").split("p AS (SELECT *, ks")[0]
    head = head.replace("WITH u", "WITH RECURSIVE u").replace("FROM events WHERE", "FROM events WHERE ts < TIMESTAMP '2024-01-02 12:00:00' AND")
    head = head.replace("max(abs(cc / n - cr / m)) AS ks", "max(abs(cc / n - cr / m)) AS ks, CAST(max(abs(cc * m - cr * n)) AS BIGINT) AS h")
    return head + """walk(feature, n, m, h, s, q) AS (
  SELECT feature, n, m, h, CAST(0 AS BIGINT), list_transform(range(0, n + 1), lambda i: 0.0::DOUBLE) FROM d
  UNION ALL SELECT feature, n, m, h, s + 1, list_transform(range(0, n + 1), lambda i:
    CASE WHEN i > s + 1 OR s + 1 - i > m THEN 0.0 WHEN abs(i * m - (s + 1 - i) * n) >= h THEN 1.0
         ELSE coalesce(q[i], 0.0) * i / (s + 1) + q[i + 1] * (s + 1 - i) / (s + 1) END::DOUBLE) FROM walk WHERE s < n + m)
SELECT d.feature, round(ks, 6) AS ks_statistic, round(CASE WHEN d.h <= 0 THEN 1.0 ELSE w.q[d.n + 1] END, 6) AS p_value,
  CASE WHEN d.h <= 0 THEN 1.0 ELSE w.q[d.n + 1] END < 0.05 AS drifted, ks > 0.3 AS statistic_alert,
  d.n AS n_current, d.m AS n_reference FROM d JOIN walk w ON w.feature = d.feature AND w.s = w.n + w.m"""


_EXACT_COLS = ["value", "user_id", "event_id"]


@register("drift_ks_exact", _exact_sql(), "A14")
def drift_ks_exact(spark, sf_dir):
    """The first day and a half: half a day against the day before it, with exact p-values."""
    ev = Tables(spark, sf_dir).events.where("ts < TIMESTAMP_NTZ '2024-01-02 12:00:00'")
    now = F.col("ts") >= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return _rounded(D.ks_drift(ev.where(now).select(*_EXACT_COLS), ev.where(~now).select(*_EXACT_COLS)))


_BUCKET_SQL = "CAST('0x' || substr(md5({k}), 1, 8) AS BIGINT) / 4294967296.0"


@register("ab_assign", f"""SELECT event_id, user_id,
  CASE WHEN {_BUCKET_SQL.format(k='CAST(user_id AS VARCHAR)')} < 0.5 THEN 'control' ELSE 'treatment' END AS arm,
  round({_BUCKET_SQL.format(k='CAST(user_id AS VARCHAR)')}, 6) AS bucket FROM events""", "F14")
def ab_assign(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select("event_id", "user_id", X.two_arm(F.col("user_id"), 0.5).alias("arm"),
                     round6(hash_unit(F.col("user_id"))).alias("bucket"))


WEIGHTS = {"v1": 0.5, "v2": 0.3, "v3": 0.2}
EPOCH = "epoch2"


def _weighted_sql():
    u = _BUCKET_SQL.format(k=f"'{EPOCH}:' || CAST(user_id AS VARCHAR)")
    return f"CASE WHEN {u} < 0.5 THEN 'v1' WHEN {u} < 0.8 THEN 'v2' ELSE 'v3' END"


@register("ab_assign_weighted", f"SELECT event_id, user_id, {_weighted_sql()} AS version FROM events", "F15")
def ab_assign_weighted(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select("event_id", "user_id", X.weighted_arm(F.col("user_id"), WEIGHTS, EPOCH).alias("version"))


_PRED_SQL = "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END"
_TRUTH_SQL = "CASE WHEN value < 5 THEN NULL WHEN value > 50 THEN 1 ELSE 0 END"


AB_RESULTS_SQL = f"""WITH t AS (SELECT {_weighted_sql()} AS version, {_PRED_SQL} AS prediction, {_TRUTH_SQL} AS truth FROM events)
SELECT version, count(*) AS total_predictions,
  count(*) FILTER (WHERE abs(prediction - truth) <= 1e-8 + 1e-5 * abs(truth)) AS correct_predictions,
  round(count(*) FILTER (WHERE abs(prediction - truth) <= 1e-8 + 1e-5 * abs(truth)) / count(*), 6) AS accuracy,
  CASE version WHEN 'v1' THEN 0.5 WHEN 'v2' THEN 0.3 ELSE 0.2 END::DOUBLE AS traffic_weight
FROM t WHERE truth IS NOT NULL GROUP BY version"""


@register("ab_results", AB_RESULTS_SQL, "A13")
def ab_results(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    t = ev.select(X.weighted_arm(F.col("user_id"), WEIGHTS, EPOCH).alias("version"),
                  F.expr(_PRED_SQL).alias("prediction"), F.expr(_TRUTH_SQL).alias("truth"))
    out = X.ab_results(t, "version", "prediction", "truth", WEIGHTS)
    return out.withColumn("accuracy", round6(F.col("accuracy")))


EPOCHS = [("launch", "2024-01-03 06:30:00", {"v1": 0.8, "v2": 0.2}), ("even", "2024-01-10 00:00:00", {"v1": 0.5, "v2": 0.5}),
          ("third arm", "2024-01-19 12:34:56", {"v1": 0.2, "v2": 0.3, "v3": 0.5})]


def _epochs_sql():
    u = _BUCKET_SQL.format(k="epoch || ':' || CAST(user_id AS VARCHAR)")
    held = " ".join(f"WHEN ts >= TIMESTAMP '{t}' THEN '{n}'" for n, t, _ in reversed(EPOCHS))
    return f"""WITH e AS (SELECT *, CASE {held} END AS epoch FROM events),
a AS (SELECT *, CASE epoch WHEN 'launch' THEN CASE WHEN {u} < 0.8 THEN 'v1' ELSE 'v2' END
    WHEN 'even' THEN CASE WHEN {u} < 0.5 THEN 'v1' ELSE 'v2' END
    WHEN 'third arm' THEN CASE WHEN {u} < 0.2 THEN 'v1' WHEN {u} < 0.5 THEN 'v2' ELSE 'v3' END END AS arm FROM e)"""


@register("ab_epoch_assign", _epochs_sql() + " SELECT event_id, epoch, arm FROM a", "F15")
def ab_epoch_assign(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "user_id", "ts")
    return X.assign_by_epoch(ev, "user_id", "ts", X.weight_history(spark, EPOCHS)).select("event_id", "epoch", "arm")


@register("ab_epoch_results", _epochs_sql() + f""", t AS (SELECT epoch, arm, {_PRED_SQL} AS prediction, {_TRUTH_SQL} AS truth FROM a)
SELECT epoch, arm, count(*) AS predictions, count(truth) AS labelled, count(*) FILTER (WHERE prediction = truth) AS correct,
  round(coalesce(count(*) FILTER (WHERE prediction = truth) / nullif(count(truth), 0), 0), 6) AS accuracy
FROM t WHERE epoch IS NOT NULL GROUP BY epoch, arm""", "F15 A13")
def ab_epoch_results(spark, sf_dir):
    ev = X.assign_by_epoch(Tables(spark, sf_dir).events, "user_id", "ts", X.weight_history(spark, EPOCHS))
    t = ev.select("epoch", "arm", F.expr(_PRED_SQL).alias("prediction"), F.expr(_TRUTH_SQL).alias("truth"))
    return X.epoch_results(t, "prediction", "truth").withColumn("accuracy", round6(F.col("accuracy")))


REF_END = "2024-01-02 00:00:00"     # the first day of events is the drift reference
_DOT_FEATURES = ["value", "user_id"]


def _dot_sql(alerts=False):
    un = " UNION ALL ".join(f"SELECT ts, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM events WHERE {c} IS NOT NULL"
                            for c in _DOT_FEATURES)
    ks = f"""WITH x AS ({un}),
cur AS (SELECT date_trunc('hour', ts) AS bucket, feature, v, count(*) AS c FROM x WHERE ts >= TIMESTAMP '{REF_END}' GROUP BY ALL),
ref AS (SELECT feature, v, count(*) AS r FROM x WHERE ts < TIMESTAMP '{REF_END}' GROUP BY ALL),
b AS (SELECT DISTINCT bucket, feature FROM cur),
u AS (SELECT bucket, feature, v, sum(c) AS c, sum(r) AS r FROM (
        SELECT bucket, feature, v, c, 0 AS r FROM cur
        UNION ALL SELECT b.bucket, ref.feature, ref.v, 0, ref.r FROM ref JOIN b ON b.feature = ref.feature) GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY bucket, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
             sum(r) OVER (PARTITION BY bucket, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
             sum(c) OVER (PARTITION BY bucket, feature) AS n, sum(r) OVER (PARTITION BY bucket, feature) AS m FROM u),
d AS (SELECT bucket, feature, max(abs(cc / n - cr / m)) AS ks, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m
      FROM w GROUP BY bucket, feature),
p AS (SELECT *, ks * sqrt(n * m / (n + m)) AS lam FROM d),
q AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
  list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam)))))
  END AS pv FROM p)"""
    if not alerts:
        return ks + """
SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, feature, round(ks, 6) AS ks_statistic, round(pv, 6) AS p_value,
  pv < 0.05 AS drifted, n AS n_current, m AS n_reference FROM q"""
    return ks + f""",
grid AS (SELECT unnest(range(min(bucket), max(bucket) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket FROM cur),
s AS (SELECT g.bucket, 'feature=' || f.feature AS labels, q.ks AS value,
        CASE WHEN coalesce(q.ks > 0.3, false) THEN 1 ELSE 0 END AS c
      FROM (SELECT DISTINCT feature FROM q) f CROSS JOIN grid g LEFT JOIN q ON q.feature = f.feature AND q.bucket = g.bucket),
h AS (SELECT *, sum(c) OVER (PARTITION BY labels ORDER BY bucket ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS held FROM s)
SELECT 'FeatureDrift' AS rule, labels, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, 'warning' AS severity,
  round(value, 6) AS value, CASE WHEN c = 0 THEN 'inactive' WHEN held >= 15 THEN 'firing' ELSE 'pending' END AS state FROM h"""


def _dot_frames(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    split = F.col("ts") < F.lit(REF_END).cast("timestamp_ntz")
    return ev.where(~split), ev.where(split)


@register("drift_over_time", _dot_sql(), "A14 K6")
def drift_over_time(spark, sf_dir):
    cur, ref = _dot_frames(spark, sf_dir)
    out = D.ks_over_time(cur, "ts", _DOT_FEATURES, ref, "1 hour")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "feature",
                      round6(F.col("ks_statistic")).alias("ks_statistic"), round6(F.col("p_value")).alias("p_value"),
                      "drifted", "n_current", "n_reference")


@register("drift_alerts", _dot_sql(alerts=True), "K6 A14")
def drift_alerts(spark, sf_dir):
    from sparkfeat.operators import metrics as MT

    cur, ref = _dot_frames(spark, sf_dir)
    out = MT.drift_alert_states(cur, "ts", _DOT_FEATURES, ref, "1 hour", for_steps=15)
    return out.select("rule", "labels", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"),
                      "severity", round6(F.col("value")).alias("value"), "state")
