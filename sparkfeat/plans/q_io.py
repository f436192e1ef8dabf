"""Catalogue: sources and sinks (S1 S5 S6 S7 S8). Each query writes a table derived from
the test data to the shared scratch folder in the reference's format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.columns import exact_mean, round6, ts_string
from sparkfeat.operators import quality as Q
from sparkfeat.sources import readers as R
from sparkfeat.sources import sinks as K
from sparkfeat.session import scratch_path
from sparkfeat.plans.registry import Tables, register

ORDERS_CSV_SCHEMA = T.StructType([
    T.StructField("O_ORDERKEY", T.LongType()), T.StructField("O_CUSTKEY", T.LongType()),
    T.StructField("O_ORDERSTATUS", T.StringType()), T.StructField("O_TOTALPRICE", T.DoubleType()),
    T.StructField("O_ORDERDATE", T.TimestampNTZType()), T.StructField("O_ORDERPRIORITY", T.StringType())])


@register("csv_scan", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total,
  strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_date FROM orders GROUP BY o_orderstatus""", "S1")
def csv_scan(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    path = scratch_path(spark, "orders-csv")
    o.toDF(*[c.upper() for c in o.columns]).write.option("header", True).csv(path)
    back = R.read_csv_typed(spark, path, ORDERS_CSV_SCHEMA)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), round6(F.sum("o_totalprice")).alias("total"),
        ts_string(F.min("o_orderdate")).alias("first_date"))


def _log_records(ev):
    return ev.select(
        F.concat(F.lit("tr-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
        (F.col("value") * 10).alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("status"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"))


@register("log_ingest", """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'v' || CAST(user_id % 3 AS VARCHAR) AS model_version, count(*) AS n, round(avg(value * 10), 6) AS mean_latency_ms,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY ALL""", "S7")
def log_ingest(spark, sf_dir):
    path = scratch_path(spark, "request-log")
    _log_records(Tables(spark, sf_dir).events).write.json(path)
    log = R.read_request_log(spark, path)
    return log.groupBy("level", "model_version").agg(
        F.count(F.lit(1)).alias("n"), round6(F.avg("latency_ms")).alias("mean_latency_ms"),
        ts_string(F.max("ts")).alias("last_ts"))


@register("stream_log_ingest", """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'v' || CAST(user_id % 3 AS VARCHAR) AS model_version, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 6)) * 10) AS DOUBLE) / count(value), 6) AS mean_latency_ms,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY ALL
UNION ALL SELECT 'broken', NULL, count(*), NULL, NULL FROM events WHERE event_id % 10 = 3""", "S7")
def stream_log_ingest(spark, sf_dir):
    """The log as a stream in which every fifth record is sent twice and every tenth is followed by a broken line."""
    from sparkfeat.streaming.streams import append_batches, slice_files

    src = scratch_path(spark, "log-stream")
    ev = Tables(spark, sf_dir).events
    text = F.to_json(F.struct("*"))
    lines = _log_records(ev).select("ts", text.alias("value"), F.substring("trace_id", 4, 20).cast("long").alias("id"))
    sent = lines.select("ts", F.explode(F.concat(F.array("value"), F.when(F.col("id") % 5 == 0, F.array("value")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("id") % 10 == 3, F.array(F.substring("value", 1, 30))).otherwise(F.array().cast("array<string>")))).alias("value"))
    # in event-time order, as a log is written: four slices of files
    edges = ev.agg(F.min("ts"), F.max("ts")).first()                          # two values
    for i in range(4):
        lo, hi = (edges[0] + (edges[1] - edges[0]) * x / 4 for x in (i, i + 1))
        part = sent.where((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) | F.lit(i == 3)))
        part.select("value").repartition(slice_files(spark)).write.mode("append").text(src)
    records, broken = R.stream_request_log(spark, src, max_files_per_trigger=slice_files(spark))
    log = append_batches(records, scratch_path(spark, "log-records"), scratch_path(spark, "log-ckpt"))
    rest = append_batches(broken, scratch_path(spark, "log-broken"), scratch_path(spark, "log-broken-ckpt"))
    out = log.groupBy("level", "model_version").agg(
        F.count(F.lit(1)).alias("n"), round6(exact_mean(F.col("latency_ms"))).alias("mean_latency_ms"),
        ts_string(F.max("ts")).alias("last_ts"))
    return out.unionByName(rest.agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit("broken")), allowMissingColumns=True)


def _run_records(o):
    m = lambda x: F.round(x, 6)
    acc = o.o_totalprice / 500000.0
    return o.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("exp_"), F.col("o_orderstatus")).alias("experiment_name"),
        F.struct(m(acc).alias("accuracy"), m(acc * 0.9).alias("precision"), m(acc * 0.8).alias("recall"),
                 m(acc * 0.85).alias("f1"), m(acc * 0.95).alias("roc_auc")).alias("metrics"),
        F.struct(F.lit(200).cast("bigint").alias("n_estimators"), F.lit(8).cast("bigint").alias("max_depth"),
                 F.lit(5).cast("bigint").alias("min_samples_split"), F.lit(4).cast("bigint").alias("min_samples_leaf"),
                 F.lit("sqrt").alias("max_features"), F.lit(42).cast("bigint").alias("random_state"),
                 F.lit("balanced_subsample").alias("class_weight"), F.lit(-1).cast("bigint").alias("n_jobs"))
        .alias("parameters"))


@register("run_records", """SELECT 'exp_' || o_orderstatus AS experiment_name, count(*) AS runs,
  max(round(o_totalprice / 500000.0, 6)) AS best_accuracy,
  'run-' || CAST(arg_max(o_orderkey, struct_pack(a := round(o_totalprice / 500000.0, 6), k := -o_orderkey)) AS VARCHAR) AS best_run,
  CAST(max(200) AS BIGINT) AS n_estimators FROM orders GROUP BY o_orderstatus""", "S8")
def run_records(spark, sf_dir):
    path = scratch_path(spark, "run-records")
    _run_records(Tables(spark, sf_dir).orders).write.json(path)
    runs = R.read_run_records(spark, path, multi_line=False)
    best = F.max_by("run_id", F.struct(F.col("metrics.accuracy"),
                                       -F.regexp_extract("run_id", r"(\d+)", 1).cast("bigint")))
    return runs.groupBy("experiment_name").agg(
        F.count(F.lit(1)).alias("runs"), F.max("metrics.accuracy").alias("best_accuracy"),
        best.alias("best_run"), F.max("parameters.n_estimators").alias("n_estimators"))


@register("report_sink", """SELECT f.feature, round(f.mn, 6) AS min, round(f.mx, 6) AS max, 'healthy' AS health FROM (
  SELECT 'c_acctbal' AS feature, min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer
  UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM customer) f""", "S5")
def report_sink(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    prof = Q.numeric_profile(c, ["c_acctbal", "c_nationkey"])
    health = c.agg(F.lit("customer_table").alias("component"),
                   F.when(F.count(F.lit(1)) > 0, F.lit("healthy")).otherwise(F.lit("degraded")).alias("status"))
    path = scratch_path(spark, "monitoring-report")
    K.write_monitoring_report(prof, health, path)
    rep = spark.read.json(path)
    return (rep.select(F.explode("feature_stats").alias("f"), F.col("health_status")[0]["status"].alias("health"))
            .select(F.col("f.feature").alias("feature"), round6(F.col("f.min")).alias("min"),
                    round6(F.col("f.max")).alias("max"), "health"))


@register("prediction_sink", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS n,
  count(*) FILTER (WHERE value > 100) AS positives FROM events GROUP BY CAST(ts AS DATE)""", "S6")
def prediction_sink(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    preds = ev.select("event_id", "ts", (F.col("value") > 100).cast("int").alias("prediction"),
                      F.lit("latest").alias("model_version"),
                      F.date_format("ts", "yyyy-MM-dd").alias("date"))
    path = scratch_path(spark, "predictions")
    split = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    K.append_table(preds.where(split), path, ["date"])       # two appends: the table grows
    K.append_table(preds.where(~split), path, ["date"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("positives"))
