"""Alert rules over a stream.

``stream_alert_changes`` runs the whole state machine in the stream: windowed aggregates hand each
finished step's value to a stateful processor keyed by (rule, labels), which keeps since when the condition
holds and emits a row when the state changes; event-time timers end a run when the data falls silent.

``stream_alert_states`` evaluates one-step rules in one streaming query: an event counts once for each label set that some
rule uses, and one update-mode aggregate per (step, label set, labels) holds the rules' values
as state, cleared by the watermark. The table of latest values is then a series like a batch's,
the open last step included, and gets its states from ``metrics.series_states``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkfeat.operators.alerting import RateRule, by_rule, label_sets, label_text, merged_columns, partial_columns
from sparkfeat.operators.metrics import AlertRule, _seconds, series_states
from sparkfeat.streaming.streams import append_batches, rocksdb, stream_to_table


def step_values(stream: DataFrame, ts: str, rules: list[AlertRule], step: str) -> DataFrame:
    """Per step, label set and labels the value of every rule (those of other label sets too)."""
    sets = list(dict.fromkeys(tuple(r.labels) for r in rules))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), label_text(list(s)).alias("labels")) for i, s in enumerate(sets)]))
    tagged = stream.withColumn("_label", each)
    return tagged.groupBy(F.window(ts, step).start.alias("bucket"), F.col("_label.set").alias("label_set"), F.col("_label.labels").alias("labels")).agg(
        *[r.value.cast("double").alias(f"v{i}") for i, r in enumerate(rules)])


def stream_alert_states(stream: DataFrame, ts: str, rules: list[AlertRule], step: str = "1 hour",
                        watermark: str = "10 minutes", name: str = "alerts") -> DataFrame:
    """States of all rules at every step between the first and the last one seen, from a
    stream drained with an ``availableNow`` trigger."""
    sets = list(dict.fromkeys(tuple(r.labels) for r in rules))
    values = stream_to_table(step_values(stream.withWatermark(ts, watermark), ts, rules, step), ["bucket", "label_set", "labels"], name)
    per_rule = F.filter(F.array(*[F.when(F.col("label_set") == sets.index(tuple(r.labels)), F.struct(
        F.lit(r.name).alias("rule"), F.col("labels").alias("labels"), F.col(f"v{i}").alias("value"))) for i, r in enumerate(rules)]),
        lambda x: x.isNotNull())
    series = values.select("bucket", F.inline(per_rule))
    span = series.agg(F.min(F.unix_timestamp("bucket")).alias("lo"), F.max(F.unix_timestamp("bucket")).alias("hi")).first()   # two numbers
    if span["lo"] is None:
        return stream.sparkSession.createDataFrame([], "rule string, labels string, bucket timestamp, severity string, value double, state string")
    return series_states(series, rules, int(span["lo"]), int(span["hi"]), int(_seconds(step)))


def rate_values(stream: DataFrame, ts: str, rules: list[RateRule], step: str, lookback: str, rows: Column | None) -> DataFrame:
    """rule, labels, value, ... of every step whose look-back holds data, once the watermark has passed it. An
    event is added once per label set to its step; the steps' partials, not the events, are then added over
    the sliding look-back. ``rows`` tells events from rows that only move the clock."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), label_text(list(s)).alias("labels")) for i, s in enumerate(label_sets(rules))]))
    real = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
    tagged = stream.select("*", each.alias("_label"))
    panes = (tagged.groupBy(F.window(ts, step), F.col("_label.set").alias("label_set"), F.col("_label.labels").alias("labels"))
             .agg(*partial_columns(rules, ts), F.count_if(real).alias("_rows")).where("_rows > 0")
             .withColumn("_at", F.window_time("window")))
    merged = (panes.groupBy(F.window("_at", lookback, step), "label_set", "labels").agg(*merged_columns(rules))
              .withColumn("end", F.window_time("window")).withColumn("at", F.unix_timestamp(F.col("window.end")) - int(_seconds(step))))
    return by_rule(merged, rules, "end", "at")


class AlertMachine(StatefulProcessor):
    """One series. State: the last step seen, since when the condition holds (-1: it does not), the state told last."""

    def __init__(self, sec: int):
        self.sec = sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", "last long, since long, state string, severity string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("at")
        last, since, state, severity = self.series.get() if self.series.exists() else (None, -1, "inactive", "")
        out = []
        for r in seen.itertuples():
            if last is not None and r.at <= last:
                continue                                              # a step is told once
            if state != "inactive" and r.at > last + self.sec:        # the data fell silent in between
                out.append((last + self.sec, r.severity, state, "inactive"))
                since, state = -1, "inactive"
            holds = r.value is not None and r.value > r.threshold     # NaN compares false
            since = (r.at if since < 0 else since) if holds else -1
            now = "inactive" if not holds else "firing" if (r.at - since) // self.sec + 1 >= r.for_steps else "pending"
            if now != state:
                out.append((r.at, r.severity, state, now))
            last, state, severity = r.at, now, r.severity
        self.series.update((int(last), int(since), state, severity))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # the step after the last one is complete when the watermark passes its end; for a quiet series the
        # timer only clears the state
        self.handle.registerTimer((int(last) + 2 * self.sec) * 1000)
        yield _changes(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.series.exists():
            return
        last, _, state, severity = self.series.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= (last + 2 * self.sec) * 1000:
            self.series.clear()
            if state != "inactive":
                yield _changes(key, [(last + self.sec, severity, state, "inactive")])

    def close(self) -> None:
        pass


CHANGES = "rule string, labels string, at long, severity string, previous string, state string"


def _changes(key, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["at", "severity", "previous", "state"])
    out.insert(0, "rule", key[0])
    out.insert(1, "labels", key[1])
    return out.astype({"at": "int64"})


def stream_alert_changes(stream: DataFrame, ts: str, rules: list[RateRule], out: str, checkpoint: str, step: str = "1 minute",
                         lookback: str = "5 minutes", watermark: str = "10 minutes", rows: Column | None = None) -> DataFrame:
    """Drains what the stream has (``availableNow``) into the table ``out`` and returns all changes told so far:
    rule, labels, bucket, severity, previous, state, as ``alerting.alert_changes`` has them. A step is told once the
    watermark has passed it. A restart with the same ``checkpoint`` and ``out`` goes on where the last ended."""
    values = rate_values(stream.withWatermark(ts, watermark), ts, rules, step, lookback, rows)
    with rocksdb(stream.sparkSession):
        changes = values.groupBy("rule", "labels").transformWithStateInPandas(
            AlertMachine(int(_seconds(step))), CHANGES, "Append", "EventTime")
        table = append_batches(changes, out, checkpoint)
    return table.select("rule", "labels", F.timestamp_seconds("at").alias("bucket"), "severity", "previous", "state")
