"""Operational metrics over a request/prediction event table, batch or streaming.

Roll-ups (A15): counter = sum by labels, gauge = last value by time, histogram =
cumulative ``le`` buckets + sum + count, summary = count + sum — all in one aggregate.
Windows (K1–K5): sliding/tumbling ``window()`` aggregates (rates, mean latency, error
share, per-minute counts, p95 with an SLO verdict). Alerts (K6): a condition must hold on
every evaluation step of its ``for`` duration over a dense time grid, so a gap in the data
resets the rule. Health (K7): ordered rules where the last matching one names the error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import as_col, exact_sum, exact_total, safe_ratio, null_safe_join
from sparkfeat.operators.ranking import keyed_quantiles

INF = float("inf")

# Histogram buckets of the reference's metric definitions (seconds / items).
REQUEST_LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5,
                           10.0, 25.0, 50.0, 75.0, 100.0, INF)
PREDICTION_LATENCY_BUCKETS = (0.001, 0.0025, 0.005, 0.0075, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25,
                              0.5, 0.75, 1.0, 2.5, 5.0)
FEATURE_PIPELINE_BUCKETS = (0.001, 0.0025, 0.005, 0.0075, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5)
EXPORTER_LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
BATCH_SIZE_BUCKETS = (1, 5, 10, 20, 50, 100)

# Alert and health thresholds of the reference.
HIGH_LATENCY_S = 0.5
HIGH_ERROR_RATE = 0.05
HIGH_MODEL_LATENCY_S = 0.1
HIGH_MEMORY_BYTES = 500_000_000
DRIFT_STATISTIC_ALERT = 0.3
MEMORY_LIMIT_MB = 2048.0
CPU_LIMIT_PERCENT = 90.0
MIN_PREDICTIONS_PER_MINUTE = 5
SLO_P95_S = 0.5
SLO_MAX_FAILURE_RATE = 0.01


def le_text(b: float) -> str:
    """Bucket bound label: '+Inf' for infinity, Python float text otherwise."""
    return "+Inf" if b == INF else str(float(b))


# ------------------------------------------------------------------------ X4 / A15
@dataclass
class MetricSpec:
    """Declarative metric: kind is counter | gauge | histogram | summary."""

    name: str
    kind: str
    value: str | Column | None = None
    labels: list[str] = field(default_factory=list)
    buckets: tuple | None = None


def histogram(df: DataFrame, labels: list[str], value, buckets=REQUEST_LATENCY_BUCKETS
              ) -> DataFrame:
    """Long rows (labels…, le, count) with cumulative counts, plus sum and count per label
    set; one aggregate with a ``count_if`` per bucket bound."""
    v = as_col(value)
    bs = list(buckets) if buckets[-1] == INF else list(buckets) + [INF]
    aggs = [F.count_if(v <= F.lit(b)).alias(f"b{i}") if b != INF
            else F.count(v).alias(f"b{i}") for i, b in enumerate(bs)]
    row = df.groupBy(*labels).agg(*aggs, F.sum(v).alias("sum"), F.count(v).alias("count"))
    structs = [F.struct(F.lit(le_text(b)).alias("le"), F.col(f"b{i}").alias("bucket_count"))
               for i, b in enumerate(bs)]
    return row.select(*labels, "sum", "count", F.inline(F.array(*structs)))


def _spec_aggregates(spec: MetricSpec, ts: str) -> list[tuple[str, Column]]:
    """(stat, aggregate) of one metric."""
    v = None if spec.value is None else as_col(spec.value).cast("double")
    if spec.kind == "counter":
        return [("value", F.count(F.lit(1)) if v is None else exact_sum(v))]
    if spec.kind == "gauge":                       # of values at the last instant the largest
        return [("value", F.max_by(v, F.struct(F.col(ts), v)))]
    if spec.kind == "summary":
        return [("count", F.count(v)), ("sum", exact_sum(v))]
    if spec.kind == "histogram":
        bounds = [b for b in spec.buckets or REQUEST_LATENCY_BUCKETS if b != INF]
        return [*[(f"le={le_text(b)}", F.count_if(v <= F.lit(float(b)))) for b in bounds], (f"le={le_text(INF)}", F.count(v)), ("sum", exact_sum(v))]
    raise ValueError(f"metric kind {spec.kind}: counter, gauge, summary or histogram")


def rollup(df: DataFrame, specs: list[MetricSpec], ts: str = "ts") -> DataFrame:
    """All metrics as rows (metric, labels ``a=1,b=2``, stat, value): one aggregate for each set of
    labels, however many metrics share it."""
    out = None
    for labels in dict.fromkeys(tuple(s.labels) for s in specs):
        stats = [(s.name, stat, agg) for s in specs if tuple(s.labels) == labels for stat, agg in _spec_aggregates(s, ts)]
        row = df.groupBy(*labels).agg(*[agg.cast("double").alias(f"_s{i}") for i, (_, _, agg) in enumerate(stats)])
        text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels])
        long = row.select(text.alias("labels"), F.inline(F.array(*[F.struct(
            F.lit(name).alias("metric"), F.lit(stat).alias("stat"), F.col(f"_s{i}").alias("value")) for i, (name, stat, _) in enumerate(stats)])))
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("at least one metric is required")
    return out.select("metric", "labels", "stat", "value")


# ------------------------------------------------------------------------ K1–K5
def windowed(df: DataFrame, ts: str, duration: str, slide: str | None, labels: list[str],
             *aggs: Column, merge: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates per window and label set. ``merge`` says how each of them follows from the same aggregates of parts of a
    window: a sliding window of a batch is then made of panes as long as a slide, so a row is read into one pane, not
    copied into every window that it falls into."""
    panes = merge is not None and slide and not df.isStreaming and _seconds(duration) % _seconds(slide) == 0
    if panes:
        first = df.groupBy(F.window(ts, slide).start.alias("_pane"), *labels).agg(*aggs)
        grouped = first.groupBy(F.window("_pane", duration, slide).alias("w"), *labels).agg(*[c.alias(n) for n, c in merge.items()])
    else:
        grouped = df.groupBy((F.window(ts, duration, slide) if slide else F.window(ts, duration)).alias("w"), *labels).agg(*aggs)
    return (grouped.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end"))
            .drop("w"))


def _seconds(duration: str) -> float:
    n, unit = duration.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}
    return float(n) * mult[unit]


def event_rate(df, ts, labels, duration="5 minutes", slide="1 minute") -> DataFrame:
    """K1: events per second over the window (PromQL ``rate`` of a counter)."""
    return windowed(df, ts, duration, slide, labels, F.count(F.lit(1)).alias("n"), merge={"n": F.sum("n")}) \
        .withColumn("rate", F.col("n") / F.lit(_seconds(duration)))


def mean_latency(df, ts, labels, latency, duration="5 minutes", slide="1 minute") -> DataFrame:
    """K2: rate(sum)/rate(count) = windowed mean."""
    v = as_col(latency)
    return windowed(df, ts, duration, slide, labels, exact_total(v).alias("latency_sum"),
                    F.count(v).alias("latency_count"), merge={c: F.sum(c) for c in ("latency_sum", "latency_count")}) \
        .withColumn("latency_sum", F.col("latency_sum").cast("double")) \
        .withColumn("mean_latency", safe_ratio(F.col("latency_sum"), F.col("latency_count")))


def error_rate(df, ts, labels, status="status", duration="5 minutes", slide="1 minute"):
    """K3: share of 5xx statuses in the window."""
    is5 = F.col(status).cast("string").startswith("5")
    return windowed(df, ts, duration, slide, labels,
                    F.count(F.lit(1)).alias("n"), F.count_if(is5).alias("errors"),
                    merge={c: F.sum(c) for c in ("n", "errors")}) \
        .withColumn("error_rate", F.col("errors") / F.col("n"))


def per_minute(df, ts, labels, duration="60 seconds", slide="30 seconds"):
    """K4: events per minute over a sliding 60 s window."""
    return windowed(df, ts, duration, slide, labels, F.count(F.lit(1)).alias("n"), merge={"n": F.sum("n")}) \
        .withColumn("per_minute", F.col("n") * F.lit(60.0 / _seconds(duration)))


def latency_slo(df, ts, labels, latency, status="status", duration="1 hour",
                p95_limit=SLO_P95_S, max_failure=SLO_MAX_FAILURE_RATE):
    """K5: windowed exact p95 latency and failure share with the SLO verdict. A window's
    latencies are ranked by distributed running sums, never gathered in one buffer."""
    return slo_from_counts(latency_counts(df, ts, labels, latency, status, duration), labels, p95_limit, max_failure)


def latency_counts(df, ts, labels, latency, status="status", duration="1 hour"):
    """Rows per window, label set, latency and failure: what a stream keeps as state."""
    fail = F.coalesce(F.col(status).cast("string").startswith("5"), F.lit(False))
    return df.groupBy(F.window(ts, duration).start.alias("window_start"), *labels, as_col(latency).cast("double").alias("latency"),
                      fail.alias("failed")).agg(F.count(F.lit(1)).alias("n"))


def slo_from_counts(counts, labels, p95_limit=SLO_P95_S, max_failure=SLO_MAX_FAILURE_RATE):
    keys = ["window_start", *labels]
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("failures"))
    p95 = keyed_quantiles(counts, keys, "latency", [0.95], weight="n").select(*keys, F.col("quantile").alias("p95"))
    out = null_safe_join(total, p95, keys, "left")
    return out.withColumn("failure_rate", F.col("failures") / F.col("n")).withColumn(
        "slo_ok", (F.col("p95") < F.lit(p95_limit)) & (F.col("failure_rate") < F.lit(max_failure)))


#: Size parameter of the latency sketches: what a window's state is bounded by.
SKETCH_K = 200


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a quantile of a KLL sketch, with 99 % confidence: the quantile at p lies between the exact
    ones at p - error and p + error."""
    return 2.296 / k ** 0.9021


def latency_sketches(df, ts, labels, latency, status="status", duration="1 hour", k: int = SKETCH_K):
    """Per window and label set the latencies as a KLL sketch, rows and failures. In a stream the state of a window
    is its sketch, however many latencies it has seen; sketches of windows merge (``merge_sketches``)."""
    fail = F.coalesce(F.col(status).cast("string").startswith("5"), F.lit(False))
    return df.groupBy(F.window(ts, duration).start.alias("window_start"), *labels).agg(
        F.kll_sketch_agg_double(number_of(latency), k).alias("sketch"), F.count(number_of(latency)).alias("latencies"),
        F.count(F.lit(1)).alias("n"), F.count_if(fail).alias("failures"))


def number_of(c) -> Column:
    x = as_col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def merge_sketches(sketches, keys: list):
    """Sketches of longer windows or fewer labels from those of shorter or more."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"),
                                       *[F.sum(c).alias(c) for c in ("latencies", "n", "failures")])


def slo_from_sketches(sketches, labels, p95_limit=SLO_P95_S, max_failure=SLO_MAX_FAILURE_RATE, k: int = SKETCH_K):
    """window_start, labels, p95, its bounds p95_low and p95_high by the rank error, n, failures, failure_rate, slo_ok,
    certain: whether the exact verdict must be the same. For that the limit's rank has to be the rank error away from 0.95
    and one place more, since a sketch has latencies themselves where the exact quantile lies between two of them."""
    error = sketch_rank_error(k)
    at = lambda p: F.when(F.col("latencies") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(max(p, 0.0), 1.0)))))
    rank = F.when(F.col("latencies") > 0, F.kll_sketch_get_rank_double("sketch", F.lit(float(p95_limit))))
    out = sketches.select("window_start", *labels, "n", "failures", at(0.95).alias("p95"), at(0.95 - error).alias("p95_low"),
                          at(0.95 + error).alias("p95_high"), (F.col("failures") / F.col("n")).alias("failure_rate"),
                          (F.abs(rank - 0.95) > F.lit(error) + F.lit(1.0) / F.col("latencies")).alias("_clear"))
    fails = ~(F.col("failure_rate") < F.lit(max_failure))
    return out.withColumns({"slo_ok": (F.col("p95") < F.lit(p95_limit)) & ~fails,
                            "certain": fails | F.coalesce(F.col("_clear"), F.lit(False))}).drop("_clear")


# ------------------------------------------------------------------------ K6
@dataclass
class AlertRule:
    name: str
    value: Column          # aggregate over one evaluation step
    threshold: float
    for_steps: int
    severity: str
    labels: list[str] = field(default_factory=list)


def alert_states(df: DataFrame, ts: str, rules: list[AlertRule], step: str = "1 hour") -> DataFrame:
    """State per rule, label set and evaluation step: inactive | pending | firing.

    Each rule is evaluated once per step on a dense grid from the first to the last step
    of the data, so steps without data count as "condition false". Firing requires the
    condition on the last ``for_steps`` consecutive steps.

    Plan: one scan and one aggregate for all rules (GROUPING SETS over the step and each
    rule's labels), unpivoted to (rule, labels, step, value) series; the dense grid is the
    series keys × the steps of the time range (bounded by the range, not the rows); runs
    of true steps are counted with a gaps-and-islands window per series.
    """
    sec = int(_seconds(step))
    epoch = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / sec) * sec
    span = df.agg(F.min(epoch).alias("lo"), F.max(epoch).alias("hi")).first()   # two numbers
    if span["lo"] is None:
        return df.sparkSession.createDataFrame(
            [], "rule string, labels string, bucket timestamp, severity string, value double, state string")
    label_cols = list(dict.fromkeys(c for r in rules for c in r.labels))
    base = df.withColumn("bucket", F.timestamp_seconds(epoch))
    values = [r.value.cast("double").alias(f"_v{i}") for i, r in enumerate(rules)]
    if label_cols:
        sets = list(dict.fromkeys(tuple(r.labels) for r in rules))
        grouped = base.groupingSets([[F.col("bucket"), *[F.col(c) for c in labs]] for labs in sets],
                                    F.col("bucket"), *[F.col(c) for c in label_cols]) \
            .agg(*values, F.grouping_id().alias("_gid"))   # bucket is always grouped (top bit 0)
    else:
        grouped = base.groupBy("bucket").agg(*values).withColumn("_gid", F.lit(0))
    n = len(label_cols)
    per_rule = []
    for i, r in enumerate(rules):
        gid = sum(1 << (n - 1 - j) for j, c in enumerate(label_cols) if c not in r.labels)
        lab = (F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in r.labels])
               if r.labels else F.lit(""))
        per_rule.append(F.when(F.col("_gid") == gid, F.struct(
            F.lit(r.name).alias("rule"), lab.alias("labels"), F.col(f"_v{i}").alias("value"))))
    series_vals = grouped.select("bucket", F.inline(F.filter(F.array(*per_rule), lambda x: x.isNotNull())))
    return series_states(series_vals, rules, int(span["lo"]), int(span["hi"]), sec)


def series_states(series_vals: DataFrame, rules: list[AlertRule], lo: int, hi: int, sec: int) -> DataFrame:
    """Alert states from per-step values (rule, labels, bucket, value): a dense grid of the
    series keys × the steps lo..hi (epoch seconds, step ``sec``), steps without a value are
    "condition false", and runs of true steps are counted per series (gaps and islands)."""
    steps = F.explode(F.transform(F.sequence(F.lit(lo), F.lit(hi), F.lit(sec)),
                                  lambda x: F.timestamp_seconds(x)))
    spec = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.struct(
        F.lit(float(r.threshold)).alias("threshold"), F.lit(int(r.for_steps)).alias("for_steps"),
        F.lit(r.severity).alias("severity")))])
    keys = series_vals.select("rule", "labels").distinct()
    grid = keys.select("rule", "labels", steps.alias("bucket"))
    full = grid.join(series_vals, ["rule", "labels", "bucket"], "left").withColumn("_r", spec[F.col("rule")])
    cond = F.coalesce(F.col("value") > F.col("_r.threshold"), F.lit(False)).cast("int")
    w = Window.partitionBy("rule", "labels").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("_c", cond).withColumn("_grp", F.sum(1 - F.col("_c")).over(w))
    wr = Window.partitionBy("rule", "labels", "_grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("_c").over(wr)
    return full.select(
        "rule", "labels", "bucket", F.col("_r.severity").alias("severity"), "value",
        F.when(F.col("_c") == 0, F.lit("inactive")).when(run >= F.col("_r.for_steps"), F.lit("firing"))
        .otherwise(F.lit("pending")).alias("state"))


def drift_alert_states(df: DataFrame, ts: str, cols: list[str], reference: DataFrame,
                       step: str = "1 hour", for_steps: int = 15,
                       statistic_alert: float = DRIFT_STATISTIC_ALERT) -> DataFrame:
    """FeatureDrift: the per-step KS statistic of a column against the reference above the
    alert level for ``for_steps`` consecutive steps (label ``feature=<column>``)."""
    from sparkfeat.operators.drift import ks_over_time

    sec = int(_seconds(step))
    epoch = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / sec) * sec
    span = df.agg(F.min(epoch).alias("lo"), F.max(epoch).alias("hi")).first()   # two numbers
    if span["lo"] is None:
        return df.sparkSession.createDataFrame(
            [], "rule string, labels string, bucket timestamp, severity string, value double, state string")
    ks = ks_over_time(df, ts, cols, reference, step)
    series = ks.select(F.lit("FeatureDrift").alias("rule"),
                       F.concat(F.lit("feature="), F.col("feature")).alias("labels"), "bucket",
                       F.col("ks_statistic").alias("value"))
    rule = AlertRule("FeatureDrift", F.lit(None), statistic_alert, for_steps, "warning")
    return series_states(series, [rule], int(span["lo"]), int(span["hi"]), sec)


# ------------------------------------------------------------------------ K7
def health_status(memory_mb: Column, cpu_percent: Column, per_minute_rate: Column,
                  model_loaded: Column) -> tuple[Column, Column]:
    """(status, error): degraded when the model is missing or any limit is crossed; the
    error text comes from the last matching check (memory, then CPU, then rate)."""
    mem = memory_mb > F.lit(MEMORY_LIMIT_MB)
    cpu = cpu_percent > F.lit(CPU_LIMIT_PERCENT)
    rate = per_minute_rate < F.lit(MIN_PREDICTIONS_PER_MINUTE)
    # Output texts of the reference.
    error = (F.when(rate, F.lit("Prediction rate below minimum expected"))
             .when(cpu, F.lit("CPU usage above threshold"))
             .when(mem, F.lit("Memory usage above threshold")))
    status = F.when(~model_loaded | mem | cpu | rate, F.lit("degraded")).otherwise(F.lit("healthy"))
    return status, error


# ------------------------------------------------------------------------ O3
def latest_versions(versions: DataFrame, stage: str, version: str, created: str, k: int = 5,
                    stages: list[str] | None = None) -> DataFrame:
    """Newest version per stage (ties → larger version), then newest first, top ``k``."""
    v = versions if stages is None else versions.where(F.col(stage).isin(*stages))
    best = v.groupBy(stage).agg(F.max_by(F.struct(version, created),
                                         F.struct(created, version)).alias("_b"))
    return best.select(stage, "_b.*").orderBy(F.desc(created), F.desc(version)).limit(k)


def leaderboard(runs: DataFrame, group: str, run_id: str, score: str, k: int = 5) -> DataFrame:
    """Top-k runs per group by score desc, id asc (planned as a WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(run_id))
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_rollup(df: DataFrame, labels: list[str], value, ts: str = "ts") -> DataFrame:
    """Counter, summary and last-value gauge of one value per label set, one aggregate."""
    v = as_col(value)
    return df.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("requests_total"), exact_sum(v).alias("value_sum"),
        F.count(v).alias("value_count"), F.max_by(v, F.col(ts)).alias("last_value"))
