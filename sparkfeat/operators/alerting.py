"""Alert rules on rates with a look-back (K6).

A rule's value at a step comes from the last ``lookback`` of data, sampled every ``step``: the rate
of a counter over five minutes, a minute apart. Each step's data is first reduced to *partials* that
merge (exact decimal sums, latest readings); a window over the steps of a series then adds the
partials of the look-back, so an event is read and shuffled once whatever the look-back is.

A series only has steps with data and the few after them in which the look-back still holds a value:
other steps have no value, so their condition is false. The states are found on these steps;
the dense grid is written out only if it is asked for, and ``alert_changes`` needs it never.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import decimal_ratio
from sparkfeat.operators.metrics import _seconds

#: What sums are kept in: addition in it is exact, so a sum does not depend on the order of its rows.
SUM_TYPE = "decimal(38,9)"
SERIES = ["rule", "labels"]


@dataclass
class RateRule:
    """``sums`` name per-event numbers that are added over the look-back, ``lasts`` per-event readings of
    which the latest counts (of equal times the largest); ``value`` makes the rule's value of them."""

    name: str
    value: Callable[[dict[str, Column]], Column]
    threshold: float
    for_steps: int
    severity: str
    labels: list[str] = field(default_factory=list)
    sums: dict[str, Column] = field(default_factory=dict)
    lasts: dict[str, Column] = field(default_factory=dict)


def mean_rule(name: str, of: Column, threshold: float, for_steps: int, severity: str, labels=()) -> RateRule:
    """rate(sum) / rate(count): the mean of the look-back's non-null values."""
    return RateRule(name, lambda p: decimal_ratio(p["s"], p["n"]), threshold, for_steps, severity, list(labels),
                    sums={"s": of, "n": of.isNotNull().cast("int")})


def last_rule(name: str, of: Column, threshold: float, for_steps: int, severity: str, labels=()) -> RateRule:
    """A gauge: its latest reading within the look-back."""
    return RateRule(name, lambda p: p["v"], threshold, for_steps, severity, list(labels), lasts={"v": of})


def label_text(labels: list[str]) -> Column:
    """``a=1,b=2``; a NULL label is an empty text, so its series is kept."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def partial_columns(rules: list[RateRule], ts: str, sum_of=lambda c: F.sum(c.cast("decimal(28,9)")).cast(SUM_TYPE)) -> list[Column]:
    """Aggregates of one step: ``s<rule>_<i>`` sums, ``l<rule>_<i>`` structs of time and reading."""
    sums = [sum_of(c).alias(f"s{r}_{i}") for r, rule in enumerate(rules) for i, c in enumerate(rule.sums.values())]
    lasts = [F.max(F.when(c.isNotNull(), F.struct(F.col(ts).alias("t"), c.cast("double").alias("v")))).alias(f"l{r}_{i}")
             for r, rule in enumerate(rules) for i, c in enumerate(rule.lasts.values())]
    return sums + lasts


def merged_columns(rules: list[RateRule], over=None) -> list[Column]:
    """The partials of several steps as one, as aggregates or over a window."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return [at(F.sum(f"s{r}_{i}")).cast(SUM_TYPE).alias(f"s{r}_{i}") for r, rule in enumerate(rules) for i in range(len(rule.sums))] + \
           [at(F.max(f"l{r}_{i}")).alias(f"l{r}_{i}") for r, rule in enumerate(rules) for i in range(len(rule.lasts))]


def rule_value(r: int, rule: RateRule) -> Column:
    parts = {n: F.col(f"s{r}_{i}") for i, n in enumerate(rule.sums)} | {n: F.col(f"l{r}_{i}.v") for i, n in enumerate(rule.lasts)}
    return rule.value(parts).cast("double")


def label_sets(rules: list[RateRule]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(r.labels) for r in rules))


def by_rule(df: DataFrame, rules: list[RateRule], *keep: str) -> DataFrame:
    """Rows (rule, labels, value, threshold, for_steps, severity) of merged partials per (label_set, labels)."""
    sets = label_sets(rules)
    each = [F.when(F.col("label_set") == sets.index(tuple(rule.labels)), F.struct(
        F.lit(rule.name).alias("rule"), F.col("labels"), rule_value(r, rule).alias("value"), F.lit(float(rule.threshold)).alias("threshold"),
        F.lit(int(rule.for_steps)).alias("for_steps"), F.lit(rule.severity).alias("severity"))) for r, rule in enumerate(rules)]
    return df.select(*keep, F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def lookback_values(df: DataFrame, ts: str, rules: list[RateRule], step: str, lookback: str) -> tuple[DataFrame, tuple[int, int] | None]:
    """(rows of rule, labels, at, value, threshold, for_steps, severity at every step whose look-back holds
    data; first and last step of the data in epoch seconds, None without data)."""
    sec, look = int(_seconds(step)), int(_seconds(lookback))
    if look % sec:
        raise ValueError("the look-back is a whole number of steps")
    epoch = (F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / sec) * sec).cast("long")
    span = df.agg(F.min(epoch).alias("lo"), F.max(epoch).alias("hi")).first()   # two numbers
    sets, cols = label_sets(rules), list(dict.fromkeys(c for r in rules for c in r.labels))
    base = df.where(F.col(ts).isNotNull()).withColumn("at", epoch)
    # one scan for all rules: a grouping set for each set of labels
    grouped = base.groupingSets([[F.col("at"), *[F.col(c) for c in s]] for s in sets], F.col("at"), *[F.col(c) for c in cols]) \
        .agg(*partial_columns(rules, ts), F.grouping_id().alias("_gid"))
    number = {sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in s): i for i, s in enumerate(sets)}
    which = F.create_map(*[F.lit(int(x)) for kv in number.items() for x in kv])
    text = F.lit(None).cast("string")
    for i, s in enumerate(sets):
        text = F.when(F.col("label_set") == i, label_text(list(s))).otherwise(text)
    partials = [f"s{r}_{i}" for r, rule in enumerate(rules) for i in range(len(rule.sums))] + \
               [f"l{r}_{i}" for r, rule in enumerate(rules) for i in range(len(rule.lasts))]
    panes = grouped.withColumn("label_set", which[F.col("_gid").cast("int")]).select("at", "label_set", text.alias("labels"), *partials)
    hi = span["hi"] if span["hi"] is not None else 0
    series = Window.partitionBy("label_set", "labels").orderBy("at")
    # a step with data, then the silent ones that its data reaches
    last = F.least(F.coalesce(F.lead("at").over(series) - sec, F.lit(hi)), F.col("at") + (look - sec), F.lit(hi))
    filled = (panes.withColumn("_last", last).withColumn("_at", F.explode(F.sequence(F.col("at"), F.col("_last"), F.lit(sec).cast("long"))))
              .select("label_set", "labels", F.col("_at").alias("at"), *[F.when(F.col("_at") == F.col("at"), F.col(p)).alias(p) for p in partials]))
    over = series.rangeBetween(-(look - sec), 0)
    merged = filled.select("label_set", "labels", "at", *merged_columns(rules, over))
    return by_rule(merged, rules, "at"), None if span["lo"] is None else (span["lo"], span["hi"])


def step_states(values: DataFrame, sec: int) -> DataFrame:
    """``state`` of each row of rule, labels, at, value, threshold, for_steps: inactive, pending, or firing
    once the condition has held on ``for_steps`` steps in a row; a step without a row breaks a run."""
    series = Window.partitionBy(*SERIES).orderBy("at")
    cond = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))
    goes_on = F.coalesce(F.lag("_c").over(series) & (F.lag("at").over(series) == F.col("at") - sec), F.lit(False))
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    since = F.last(F.when(F.col("_c") & ~F.col("_goes_on"), F.col("at")), ignorenulls=True).over(so_far)
    held = (F.col("at") - since) / sec + 1
    return (values.withColumn("_c", cond).withColumn("_goes_on", goes_on)
            .withColumn("state", F.when(~F.col("_c"), "inactive").when(held >= F.col("for_steps"), "firing").otherwise("pending"))
            .drop("_c", "_goes_on"))


def lookback_states(df: DataFrame, ts: str, rules: list[RateRule], step: str = "1 minute", lookback: str = "5 minutes") -> DataFrame:
    """rule, labels, bucket, severity, value, state at every step between the first and the last of the data, for
    every series that has data."""
    sec = int(_seconds(step))
    values, span = lookback_values(df, ts, rules, step, lookback)
    lo, hi = span or (0, 0)
    series = Window.partitionBy(*SERIES).orderBy("at")
    states = step_states(values, sec).withColumn("_next", F.lead("at").over(series)).withColumn("_first", F.lag("at").over(series).isNull())

    def silent(first: Column, last: Column) -> Column:
        steps = F.when(first <= last, F.sequence(first, last, F.lit(sec).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(steps, lambda t: F.struct(t.alias("at"), F.lit(None).cast("double").alias("value"), F.lit("inactive").alias("state")))
    own = F.array(F.struct("at", "value", "state"))
    before = F.when(F.col("_first"), silent(F.lit(lo).cast("long"), F.col("at") - sec)).otherwise(silent(F.lit(1).cast("long"), F.lit(0).cast("long")))
    after = silent(F.col("at") + sec, F.coalesce(F.col("_next") - sec, F.lit(hi).cast("long")))
    return (states.select("rule", "labels", "severity", F.inline(F.concat(before, own, after)))
            .select("rule", "labels", F.timestamp_seconds("at").alias("bucket"), "severity", "value", "state"))


def alert_changes(df: DataFrame, ts: str, rules: list[RateRule], step: str = "1 minute", lookback: str = "5 minutes") -> DataFrame:
    """The steps at which a series' state differs from the step before (inactive before the first):
    rule, labels, bucket, severity, previous, state."""
    sec = int(_seconds(step))
    values, span = lookback_values(df, ts, rules, step, lookback)
    hi = (span or (0, 0))[1]
    series = Window.partitionBy(*SERIES).orderBy("at")
    states = step_states(values, sec).withColumn("_next", F.lead("at").over(series))
    runs_out = (F.col("state") != "inactive") & (F.col("at") + sec <= hi) & F.coalesce(F.col("_next") > F.col("at") + sec, F.lit(True))
    points = F.array(F.struct(F.col("at"), F.col("state")), F.when(runs_out, F.struct((F.col("at") + sec).alias("at"), F.lit("inactive").alias("state"))))
    steps = states.select("rule", "labels", "severity", F.inline(F.filter(points, lambda p: p.isNotNull())))
    return (steps.withColumn("previous", F.lag("state", 1, "inactive").over(series)).where("state <> previous")
            .select("rule", "labels", F.timestamp_seconds("at").alias("bucket"), "severity", "previous", "state"))
