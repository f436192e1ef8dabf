"""Catalogue: metric roll-ups, windowed rates/latency/errors, SLO, alerts, health,
model-version listings (A15 X4 K1–K7 O3 S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import exact_mean, round6, ts_string
from sparkfeat.operators import alerting as AL
from sparkfeat.operators import metrics as MT
from sparkfeat.plans.registry import Tables, register

# Stand-in request log on events (FIXTURES.md B): latency = value/100 s, 'error' = 5xx.
_LOG_SQL = """(SELECT ts, '/api/v1/' || event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 100 AS latency,
  'v' || CAST(user_id % 3 AS VARCHAR) AS model_version, user_id, event_type, value FROM events)"""
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def request_log(t):
    return request_columns(t.events)


def request_columns(ev):
    return ev.select(
        "ts", F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("status"),
        (F.col("value") / 100).alias("latency"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
        "user_id", "event_type", "value")


@register("metric_rollup", f"""SELECT endpoint, status, count(*) AS requests_total, round(sum(latency), 6) AS value_sum,
  count(latency) AS value_count, round(arg_max(latency, ts), 6) AS last_value FROM {_LOG_SQL} GROUP BY endpoint, status""",
          "A15 X4")
def metric_rollup(spark, sf_dir):
    out = MT.label_rollup(request_log(Tables(spark, sf_dir)), ["endpoint", "status"], "latency")
    return out.withColumns({"value_sum": round6(F.col("value_sum")),
                            "last_value": round6(F.col("last_value"))})


def _hist_sql():
    bs = MT.REQUEST_LATENCY_BUCKETS
    aggs = ", ".join((f"count(*) FILTER (WHERE latency <= {b}) AS b{i}" if b != MT.INF else f"count(latency) AS b{i}")
                     for i, b in enumerate(bs))
    rows = " UNION ALL ".join(f"SELECT endpoint, s, c, '{MT.le_text(b)}' AS le, b{i} AS bucket_count FROM a"
                              for i, b in enumerate(bs))
    return (f"WITH a AS (SELECT endpoint, sum(latency) AS s, count(latency) AS c, {aggs} FROM {_LOG_SQL} GROUP BY endpoint) "
            f"SELECT endpoint, round(s, 6) AS sum, c AS count, le, bucket_count FROM ({rows})")


@register("latency_histogram", _hist_sql(), "A15")
def latency_histogram(spark, sf_dir):
    out = MT.histogram(request_log(Tables(spark, sf_dir)), ["endpoint"], "latency",
                       MT.REQUEST_LATENCY_BUCKETS)
    return out.withColumn("sum", round6(F.col("sum")))


_SLIDE5 = f"(SELECT l.*, date_trunc('minute', ts) - to_minutes(k) AS ws FROM {_LOG_SQL} l, range(0, 5) t(k))"


RATE_5M_SQL = f"""SELECT {_TS.format(c='ws')} AS window_start, endpoint, count(*) AS n, round(count(*) / 300.0, 6) AS rate
FROM {_SLIDE5} GROUP BY ws, endpoint"""


@register("rate_5m", RATE_5M_SQL, "K1")
def rate_5m(spark, sf_dir):
    out = MT.event_rate(request_log(Tables(spark, sf_dir)), "ts", ["endpoint"])
    return out.select(ts_string(F.col("window_start")).alias("window_start"), "endpoint", "n",
                      round6(F.col("rate")).alias("rate"))


@register("latency_avg_5m", f"""SELECT {_TS.format(c='ws')} AS window_start, model_version, round(sum(latency), 6) AS latency_sum,
  count(latency) AS latency_count, round(avg(latency), 6) AS mean_latency FROM {_SLIDE5} GROUP BY ws, model_version""", "K2")
def latency_avg_5m(spark, sf_dir):
    out = MT.mean_latency(request_log(Tables(spark, sf_dir)), "ts", ["model_version"], "latency")
    return out.select(ts_string(F.col("window_start")).alias("window_start"), "model_version",
                      round6(F.col("latency_sum")).alias("latency_sum"), "latency_count",
                      round6(F.col("mean_latency")).alias("mean_latency"))


@register("error_rate_5m", f"""SELECT {_TS.format(c='ws')} AS window_start, count(*) AS n,
  count(*) FILTER (WHERE status LIKE '5%') AS errors, round(count(*) FILTER (WHERE status LIKE '5%') / count(*), 6) AS error_rate
FROM {_SLIDE5} GROUP BY ws""", "K3")
def error_rate_5m(spark, sf_dir):
    out = MT.error_rate(request_log(Tables(spark, sf_dir)), "ts", [])
    return out.select(ts_string(F.col("window_start")).alias("window_start"), "n", "errors",
                      round6(F.col("error_rate")).alias("error_rate"))


_METRICS = [
    MT.MetricSpec("requests_total", "counter", None, ["endpoint", "status"]),
    MT.MetricSpec("request_latency", "histogram", "latency", ["endpoint"], MT.EXPORTER_LATENCY_BUCKETS),
    MT.MetricSpec("request_value", "summary", "value", ["endpoint"]),
    MT.MetricSpec("prediction_latency", "histogram", "latency", ["model_version"], MT.PREDICTION_LATENCY_BUCKETS),
    MT.MetricSpec("last_latency", "gauge", "latency", ["model_version"]),
]


def _metrics_sql() -> str:
    parts = []
    for m in _METRICS:
        labels = " || ',' || ".join(f"'{c}=' || {c}" for c in m.labels)
        v = m.value
        stats = {"counter": lambda: [("value", "count(*)")], "summary": lambda: [("count", f"count({v})"), ("sum", f"sum({v})")],
                 "gauge": lambda: [("value", f"arg_max({v}, struct_pack(t := ts, v := {v}))")],
                 "histogram": lambda: [*[(f"le={MT.le_text(b)}", f"count(*) FILTER (WHERE {v} <= {b})") for b in m.buckets],
                                       ("le=+Inf", f"count({v})"), ("sum", f"sum({v})")]}[m.kind]()
        parts += [f"SELECT '{m.name}' AS metric, {labels} AS labels, '{stat}' AS stat, round(CAST({agg} AS DOUBLE), 6) AS value "
                  f"FROM {_LOG_SQL} GROUP BY {', '.join(m.labels)}" for stat, agg in stats]
    return "\nUNION ALL ".join(parts)


@register("metric_specs", _metrics_sql(), "X4 A15")
def metric_specs(spark, sf_dir):
    return MT.rollup(request_log(Tables(spark, sf_dir)), _METRICS).withColumn("value", round6(F.col("value")))


@register("pred_per_min", f"""SELECT {_TS.format(c='ws')} AS window_start, count(*) AS n, round(count(*) * 1.0, 6) AS per_minute FROM (
  SELECT make_timestamp(CAST(floor(epoch_us(ts) / 30000000) * 30000000 AS BIGINT)) - to_seconds(30 * k) AS ws
  FROM {_LOG_SQL} l, range(0, 2) t(k) WHERE status = '200') GROUP BY ws""", "K4")
def pred_per_min(spark, sf_dir):
    log = request_log(Tables(spark, sf_dir)).where(F.col("status") == "200")
    out = MT.per_minute(log, "ts", [])
    return out.select(ts_string(F.col("window_start")).alias("window_start"), "n",
                      round6(F.col("per_minute")).alias("per_minute"))


LATENCY_SLO_SQL = f"""SELECT {_TS.format(c="date_trunc('hour', ts)")} AS window_start,
  round(quantile_cont(latency, 0.95), 6) AS p95, count(*) AS n, count(*) FILTER (WHERE status LIKE '5%') AS failures,
  round(count(*) FILTER (WHERE status LIKE '5%') / count(*), 6) AS failure_rate,
  quantile_cont(latency, 0.95) < 0.5 AND count(*) FILTER (WHERE status LIKE '5%') / count(*) < 0.01 AS slo_ok
FROM {_LOG_SQL} GROUP BY date_trunc('hour', ts)"""


@register("latency_p95_slo", LATENCY_SLO_SQL, "K5")
def latency_p95_slo(spark, sf_dir):
    out = MT.latency_slo(request_log(Tables(spark, sf_dir)), "ts", [], "latency")
    return out.select(ts_string(F.col("window_start")).alias("window_start"),
                      round6(F.col("p95")).alias("p95"), "n", "failures",
                      round6(F.col("failure_rate")).alias("failure_rate"), "slo_ok")


# a mean from an exact sum, whatever the order of the rows; and its sixth decimal where the seventh is a tie
_MEAN_SQL = "CAST(sum(CAST(latency AS DECIMAL(28, 9))) AS DOUBLE) / count(latency)"
_ROUND_SQL = "CASE WHEN abs({v}) < 1e6 THEN CAST(round(CAST({v} AS DECIMAL(18, 9)), 6) AS DOUBLE) ELSE round({v}, 6) END"


# (rule, label column or None, value aggregate in Spark, the same in SQL, threshold, steps, severity)
_ALERT_RULES = [
    ("HighLatency", "endpoint", lambda: exact_mean(F.col("latency")), _MEAN_SQL, MT.HIGH_LATENCY_S, 5, "warning"),
    ("HighErrorRate", None, lambda: F.avg(F.when(F.col("status").startswith("5"), 1.0).otherwise(0.0)),
     "avg(CASE WHEN status LIKE '5%' THEN 1.0 ELSE 0.0 END)::DOUBLE", MT.HIGH_ERROR_RATE, 5, "critical"),
    ("HighModelLatency", "model_version", lambda: exact_mean(F.col("latency")), _MEAN_SQL,
     MT.HIGH_MODEL_LATENCY_S, 5, "warning"),
    # memory gauge stand-in: last value of the step × 10 MB, per instance
    ("HighMemoryUsage", "instance", lambda: F.max_by(F.col("value") * 1e7, "ts"), "arg_max(value * 1e7, ts)",
     MT.HIGH_MEMORY_BYTES, 5, "warning"),
    # store health gauge stand-in: 0 when the step's last event is an error → alert on 1 - health
    ("FeatureStoreUnhealthy", "instance",
     lambda: F.max_by((F.col("event_type") == "error").cast("double"), "ts"),
     "arg_max(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END, ts)::DOUBLE", 0.5, 5, "critical"),
]


def alert_rules() -> list[MT.AlertRule]:
    return [MT.AlertRule(name, value(), thr, steps, sev, [label] if label else [])
            for name, label, value, _, thr, steps, sev in _ALERT_RULES]


def alert_log(events):
    return request_columns(events).withColumn("instance", F.concat(F.lit("pod-"), (F.col("user_id") % 3).cast("string")))


def _alert_sql():
    """Oracle for the alert states."""
    parts = []
    for name, label, _, agg, thr, steps, sev in _ALERT_RULES:
        if label:
            parts.append(f"""SELECT '{name}' AS rule, '{label}=' || k.{label} AS labels, g.bucket, '{sev}' AS severity, v.value,
    CASE WHEN coalesce(v.value > {thr}, false) THEN 1 ELSE 0 END AS c, {steps} AS steps
  FROM (SELECT DISTINCT {label} FROM b) k CROSS JOIN grid g
  LEFT JOIN (SELECT bucket, {label}, {agg} AS value FROM b GROUP BY bucket, {label}) v ON v.{label} = k.{label} AND v.bucket = g.bucket""")
        else:
            parts.append(f"""SELECT '{name}' AS rule, '' AS labels, g.bucket, '{sev}' AS severity, v.value,
    CASE WHEN coalesce(v.value > {thr}, false) THEN 1 ELSE 0 END AS c, {steps} AS steps
  FROM grid g LEFT JOIN (SELECT bucket, {agg} AS value FROM b GROUP BY bucket) v ON v.bucket = g.bucket""")
    body = "\n  UNION ALL\n".join(parts)
    return f"""WITH b AS (SELECT *, date_trunc('hour', ts) AS bucket, 'pod-' || CAST(user_id % 3 AS VARCHAR) AS instance FROM {_LOG_SQL}),
grid AS (SELECT unnest(range(min(bucket), max(bucket) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket FROM b),
s AS (SELECT *, sum(c) OVER (PARTITION BY rule, labels ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held
  FROM ({body}))
SELECT rule, labels, {_TS.format(c='bucket')} AS bucket, severity, {_ROUND_SQL.format(v='value')} AS value,
  CASE WHEN c = 0 THEN 'inactive' WHEN held >= steps THEN 'firing' ELSE 'pending' END AS state FROM s"""


ALERTS_SQL = _alert_sql()


@register("alerts", ALERTS_SQL, "K6")
def alerts(spark, sf_dir):
    out = MT.alert_states(alert_log(Tables(spark, sf_dir).events), "ts", alert_rules(), "1 hour")
    return out.select("rule", "labels", ts_string(F.col("bucket")).alias("bucket"), "severity",
                      round6(F.col("value")).alias("value"), "state")


def rate_rules() -> list[AL.RateRule]:
    """The same five rules on rates and gauges of the last five minutes."""
    is_error = F.when(F.col("status").startswith("5"), 1.0).otherwise(0.0)
    return [
        AL.mean_rule("HighLatency", F.col("latency"), MT.HIGH_LATENCY_S, 5, "warning", ["endpoint"]),
        AL.mean_rule("HighErrorRate", is_error, MT.HIGH_ERROR_RATE, 5, "critical"),
        AL.mean_rule("HighModelLatency", F.col("latency"), MT.HIGH_MODEL_LATENCY_S, 5, "warning", ["model_version"]),
        AL.last_rule("HighMemoryUsage", F.col("value") * 1e7, MT.HIGH_MEMORY_BYTES, 5, "warning", ["instance"]),
        AL.last_rule("FeatureStoreUnhealthy", (F.col("event_type") == "error").cast("double"), 0.5, 5, "critical", ["instance"]),
    ]


def _rate_states_sql() -> str:
    """States of ``rate_rules`` on the dense minute grid: window sums of per-minute partials."""
    mean = "CAST(sum(CAST({c} AS DECIMAL(28, 9))) AS DECIMAL(38, 9)) AS s, count({c}) AS n, NULL::DOUBLE AS v"
    last = "0::DECIMAL(38, 9) AS s, 0 AS n, arg_max({c}, struct_pack(t := ts, v := {c}))::DOUBLE AS v"
    error = "CASE WHEN {0} THEN 1.0 ELSE 0.0 END"
    rules = [("HighLatency", "endpoint", mean.format(c="latency"), MT.HIGH_LATENCY_S, "warning"),
             ("HighErrorRate", None, mean.format(c=error.format("status LIKE '5%'")), MT.HIGH_ERROR_RATE, "critical"),
             ("HighModelLatency", "model_version", mean.format(c="latency"), MT.HIGH_MODEL_LATENCY_S, "warning"),
             ("HighMemoryUsage", "instance", last.format(c="(value * 1e7)"), MT.HIGH_MEMORY_BYTES, "warning"),
             ("FeatureStoreUnhealthy", "instance", last.format(c=f"({error.format(chr(39).join(['event_type = ', 'error', '']))})"), 0.5, "critical")]
    parts = []
    for name, label, partials, threshold, severity in rules:
        text = f"'{label}=' || {label}" if label else "''"
        parts.append(f"""SELECT '{name}' AS rule, k.labels, g.bucket, '{severity}' AS severity, {threshold} AS threshold, p.s, p.n, p.v
  FROM (SELECT DISTINCT {text} AS labels FROM b) k CROSS JOIN grid g
  LEFT JOIN (SELECT bucket, {text} AS labels, {partials} FROM b GROUP BY ALL) p ON p.labels = k.labels AND p.bucket = g.bucket""")
    body = "\n  UNION ALL\n".join(parts)
    return f"""WITH b AS (SELECT *, date_trunc('minute', ts) AS bucket, 'pod-' || CAST(user_id % 3 AS VARCHAR) AS instance FROM {_LOG_SQL}),
grid AS (SELECT unnest(range(min(bucket), max(bucket) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS bucket FROM b),
w AS (SELECT *, coalesce(CASE WHEN sum(n) OVER look > 0 THEN CAST(sum(s) OVER look AS DOUBLE) / sum(n) OVER look END,
    last_value(v IGNORE NULLS) OVER look) AS value FROM ({body})
  WINDOW look AS (PARTITION BY rule, labels ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN coalesce(value > threshold, false) THEN 1 ELSE 0 END AS c FROM w),
s AS (SELECT *, sum(c) OVER (PARTITION BY rule, labels ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM c),
states AS (SELECT rule, labels, bucket, severity, value,
  CASE WHEN c = 0 THEN 'inactive' WHEN held >= 5 THEN 'firing' ELSE 'pending' END AS state FROM s)
"""


@register("alerts_5m", _rate_states_sql() + f"""SELECT rule, labels, {_TS.format(c='bucket')} AS bucket, severity,
  {_ROUND_SQL.format(v='value')} AS value, state FROM states""", "K6")
def alerts_5m(spark, sf_dir):
    out = AL.lookback_states(alert_log(Tables(spark, sf_dir).events), "ts", rate_rules())
    return out.withColumns({"bucket": ts_string(F.col("bucket")), "value": round6(F.col("value"))})


ALERT_CHANGES_SQL = _rate_states_sql() + f"""SELECT rule, labels, {_TS.format(c='bucket')} AS bucket, severity, previous, state FROM (
  SELECT *, coalesce(lag(state) OVER (PARTITION BY rule, labels ORDER BY bucket), 'inactive') AS previous FROM states)
WHERE state <> previous"""


@register("alert_changes", ALERT_CHANGES_SQL, "K6")
def alert_changes(spark, sf_dir):
    out = AL.alert_changes(alert_log(Tables(spark, sf_dir).events), "ts", rate_rules())
    return out.withColumn("bucket", ts_string(F.col("bucket")))


@register("health_rollup", f"""WITH h AS (SELECT 'pod-' || CAST(user_id % 3 AS VARCHAR) AS instance, date_trunc('hour', ts) AS bucket,
    arg_max(value, ts) * 10 AS memory_mb, avg(value) / 2 AS cpu_percent, count(*) / 60.0 AS rate,
    count(*) FILTER (WHERE event_type <> 'error') > 0 AS model_loaded
  FROM events GROUP BY ALL)
SELECT instance, {_TS.format(c='bucket')} AS bucket, round(memory_mb, 6) AS memory_mb, round(cpu_percent, 6) AS cpu_percent,
  round(rate, 6) AS rate, model_loaded,
  CASE WHEN NOT model_loaded OR memory_mb > 2048.0 OR cpu_percent > 90.0 OR rate < 5 THEN 'degraded' ELSE 'healthy' END AS status,
  CASE WHEN rate < 5 THEN 'Prediction rate below minimum expected' WHEN cpu_percent > 90.0 THEN 'CPU usage above threshold'
       WHEN memory_mb > 2048.0 THEN 'Memory usage above threshold' END AS error
FROM h""", "K7")
def health_rollup(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    h = ev.groupBy(F.concat(F.lit("pod-"), (F.col("user_id") % 3).cast("string")).alias("instance"),
                   F.date_trunc("hour", "ts").alias("bucket")).agg(
        (F.max_by("value", "ts") * 10).alias("memory_mb"), (F.avg("value") / 2).alias("cpu_percent"),
        (F.count(F.lit(1)) / 60).alias("rate"), (F.count_if(F.col("event_type") != "error") > 0).alias("model_loaded"))
    status, error = MT.health_status(F.col("memory_mb"), F.col("cpu_percent"), F.col("rate"),
                                     F.col("model_loaded"))
    return h.select("instance", ts_string(F.col("bucket")).alias("bucket"),
                    round6(F.col("memory_mb")).alias("memory_mb"),
                    round6(F.col("cpu_percent")).alias("cpu_percent"), round6(F.col("rate")).alias("rate"), "model_loaded",
                    status.alias("status"), error.alias("error"))


@register("latest_model_versions", f"""SELECT stage, version, {_TS.format(c='created')} AS created FROM (
  SELECT o_orderstatus AS stage, o_orderkey AS version, o_orderdate AS created,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1 ORDER BY created DESC, version DESC LIMIT 5""", "O3")
def latest_model_versions(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("stage"),
                                            F.col("o_orderkey").alias("version"),
                                            F.col("o_orderdate").alias("created"))
    out = MT.latest_versions(o, "stage", "version", "created", k=5)
    return out.select("stage", "version", ts_string(F.col("created")).alias("created"))


@register("run_leaderboard", """SELECT stage, run_id, round(score, 6) AS score, rank FROM (
  SELECT o_orderstatus AS stage, o_orderkey AS run_id, o_totalprice AS score,
    CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey ASC) AS INTEGER) AS rank FROM orders)
WHERE rank <= 5""", "O3 S8")
def run_leaderboard(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("stage"),
                                            F.col("o_orderkey").alias("run_id"),
                                            F.col("o_totalprice").alias("score"))
    out = MT.leaderboard(o, "stage", "run_id", "score", 5)
    return out.withColumn("score", round6(F.col("score")))
