"""Two-sample Kolmogorov–Smirnov drift per shared numeric column.

Plan: both sides → (feature, value) with NULL/NaN dropped → one aggregate of counts per
distinct (feature, value) (ties collapse, which the statistic requires) → distributed
running sums in value order (``ranking.running_totals``: range partitions + broadcast
offsets, no single-task window) → D = max |F_cur − F_ref| per feature.

p-value (asymptotic Kolmogorov distribution): λ = D·√(n·m/(n+m)),
p = 2·Σ_{k=1..100} (−1)^{k−1}·exp(−2k²λ²), clamped to [0, 1], and 1 when λ < 0.2.

Samples of up to ``EXACT_ROWS`` values on either side get the exact p-value: the share of the
lattice paths from (0, 0) to (n, m) that reach a point with |i/n − j/m| ≥ D, by one recursion over
the anti-diagonals of the n × m grid. The statistic is compared in whole numbers, so no rounding
decides a tie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.operators.ranking import running_totals_and_sums
from sparkfeat.session import ship_package

DEFAULT_THRESHOLD = 0.05
SERIES_TERMS = 100
EXACT_ROWS = 10_000        # the larger sample's size up to which p-values are exact
P_VALUE_METHODS = ("auto", "exact", "asymptotic")
STATISTIC_ALERT = 0.3      # fixed value: alert level on the drift statistic


def ks_p_value(d: Column, n: Column, m: Column, terms: int = SERIES_TERMS) -> Column:
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(terms)),
                    lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
                    * F.exp(F.lit(-2.0) * k * k * lam * lam)),
        F.lit(0.0), lambda acc, x: acc + x)
    return F.when(lam < F.lit(0.2), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def exact_p_value(gap: int, n: int, m: int) -> float:
    """P(max |i·m − j·n| ≥ gap) over all orders of n and m values. q(i, j) is the chance that a random path to
    (i, j) has left the band: 1 outside of it, else i/(i+j)·q(i−1, j) + j/(i+j)·q(i, j−1). Only sums of
    positive numbers, so small p-values keep their digits; n + m steps on vectors of the shorter side."""
    if gap <= 0:
        return 1.0
    if n > m:
        n, m = m, n
    i = np.arange(n + 1)
    q = np.zeros(n + 1)                                    # entry i of diagonal s stands for (i, s − i)
    for s in range(1, n + m + 1):
        lo, hi = max(0, s - m), min(n, s)
        at = i[lo:hi + 1]
        new = (s - at) / s * q[lo:hi + 1]
        new[1 if lo == 0 else 0:] += (at[at > 0] / s) * q[(max(lo, 1) - 1):hi]
        new[np.abs(at * m - (s - at) * n) >= gap] = 1.0
        q[lo:hi + 1] = new
    return float(min(1.0, q[n]))


@F.pandas_udf(T.DoubleType())
def _exact_p(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """One call per compared pair of samples, not per row of them; no gap, no value."""
    return pd.Series([None if pd.isna(g) else exact_p_value(int(g), int(a), int(b)) for g, a, b in zip(gap, n, m, strict=True)], dtype="float64")


def shared_numeric_columns(current: DataFrame, reference: DataFrame) -> list[str]:
    ref = {f.name for f in reference.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [f.name for f in current.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name in ref]


def _long(df: DataFrame, cols: list[str], side: int) -> DataFrame:
    v = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))
    return v.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("side", F.lit(side))


def value_counts_by_side(current: DataFrame, reference: DataFrame, cols: list[str]) -> DataFrame:
    both = _long(current, cols, 1).unionByName(_long(reference, cols, 0))
    return both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 1).alias("n_cur"), F.count_if(F.col("side") == 0).alias("n_ref"))


def ks_drift(current: DataFrame, reference: DataFrame, cols: list[str] | None = None,
             threshold: float = DEFAULT_THRESHOLD, num_partitions: int | None = None,
             counts: DataFrame | None = None, statistic_alert: float = STATISTIC_ALERT,
             method: str = "auto", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """feature, ks_statistic, p_value, drifted (p < threshold), statistic_alert
    (D > the alert level on the statistic), n_current, n_reference.

    ``counts`` may supply precomputed (feature, value, n_cur, n_ref) rows, e.g. a baseline
    kept as a sorted (value, count) table by a stream. ``method`` of the p-value: "exact",
    "asymptotic", or "auto": exact where neither sample has more than ``exact_rows`` values.
    """
    if method not in P_VALUE_METHODS:
        raise ValueError(f"method must be one of {P_VALUE_METHODS}")
    cols = cols or shared_numeric_columns(current, reference)
    vc = counts if counts is not None else value_counts_by_side(current, reference, cols)
    cum, sums = running_totals_and_sums(vc, ["feature"], ["value"], ["n_cur", "n_ref"], num_partitions)
    totals = sums.select("feature", F.col("tot_n_cur").alias("n"), F.col("tot_n_ref").alias("m"))
    # one row per feature: broadcasting it is bounded by the column count
    gaps = cum.join(F.broadcast(totals), "feature").select(
        "feature", "n", "m",
        F.abs(F.try_divide(F.col("cum_n_cur"), F.col("n")) -
              F.try_divide(F.col("cum_n_ref"), F.col("m"))).alias("gap"), "cum_n_cur", "cum_n_ref")
    small = F.lit(method == "exact") | (F.lit(method == "auto") & (F.greatest("n", "m") <= F.lit(exact_rows)))
    # i·m − j·n as a whole number, where it is asked for (long there: both samples are small, or the caller says so)
    whole = F.when(small & (F.col("n") > 0) & (F.col("m") > 0), F.abs(F.col("cum_n_cur") * F.col("m") - F.col("cum_n_ref") * F.col("n")))
    d = gaps.withColumn("whole", whole).groupBy("feature").agg(
        F.max("gap").alias("ks_statistic"), F.first("n").alias("n_current"), F.first("m").alias("n_reference"), F.max("whole").alias("whole"))
    p = ks_p_value(F.col("ks_statistic"), F.col("n_current").cast("double"),
                   F.col("n_reference").cast("double"))
    if method != "asymptotic":
        ship_package(d.sparkSession)
        p = F.coalesce(_exact_p("whole", "n_current", "n_reference"), p)
    return d.withColumn("p", p).select("feature", "ks_statistic", F.col("p").alias("p_value"),
                    (F.col("p") < F.lit(threshold)).alias("drifted"),
                    (F.col("ks_statistic") > F.lit(statistic_alert)).alias("statistic_alert"),
                    "n_current", "n_reference")


def ks_over_time(df: DataFrame, ts: str, cols: list[str], reference: DataFrame,
                 step: str = "1 hour", threshold: float = DEFAULT_THRESHOLD,
                 num_partitions: int | None = None) -> DataFrame:
    """KS statistic of every time step's sample against one reference sample, per column.

    For a step's sample C (n values) and the reference R (m values) the statistic is
    max |F_C − F_R| over all jump points. Between two consecutive values of C, F_C is
    constant and F_R only grows, so it suffices to look at each value v of C, both at v and
    just below it:  D = max_v max(|F_C(v) − F_R(v)|, |F_C(v⁻) − F_R(v⁻)|).
    F_R(v) and F_R(v⁻) come from one distributed running sum over the distinct values of
    C (all steps) ∪ R — the reference is never copied per step — and F_C per step from a
    running sum keyed by (step, column). Output: bucket, feature, ks_statistic, p_value,
    drifted, n_current, n_reference.
    """
    from sparkfeat.operators.metrics import _seconds

    sec = int(_seconds(step))
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / sec) * sec)

    def long(frame, with_bucket):
        extra = [bucket.alias("bucket")] if with_bucket else []
        out = frame.select(*extra, F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))
        return out.where(F.col("value").isNotNull() & ~F.isnan("value"))

    cur = long(df, True).groupBy("bucket", "feature", "value").agg(F.count(F.lit(1)).alias("n_cur"))
    ref = long(reference, False).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_ref"))
    # reference CDF at every distinct current value (and at the reference's own values)
    pts = (cur.select("feature", "value", F.lit(0).cast("bigint").alias("n_ref"))
           .unionByName(ref).groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref")))
    rcdf, rsum = running_totals_and_sums(pts, ["feature"], ["value"], ["n_ref"], num_partitions)
    rcdf = rcdf.select("feature", "value", F.col("cum_n_ref").alias("r_le"),
                       (F.col("cum_n_ref") - F.col("n_ref")).alias("r_lt"))
    ccdf, csum = running_totals_and_sums(cur, ["bucket", "feature"], ["value"], ["n_cur"], num_partitions)
    m = rsum.select("feature", F.col("tot_n_ref").alias("m"))
    n = csum.select("bucket", "feature", F.col("tot_n_cur").alias("n"))
    j = (ccdf.join(rcdf, ["feature", "value"]).join(n, ["bucket", "feature"])
         .join(F.broadcast(m), "feature"))        # m: one row per column
    fc, fc_lt = F.col("cum_n_cur") / F.col("n"), (F.col("cum_n_cur") - F.col("n_cur")) / F.col("n")
    fr, fr_lt = F.col("r_le") / F.col("m"), F.col("r_lt") / F.col("m")
    gap = F.greatest(F.abs(fc - fr), F.abs(fc_lt - fr_lt))
    d = j.groupBy("bucket", "feature").agg(F.max(gap).alias("ks_statistic"),
                                           F.first("n").alias("n_current"), F.first("m").alias("n_reference"))
    p = ks_p_value(F.col("ks_statistic"), F.col("n_current").cast("double"), F.col("n_reference").cast("double"))
    return d.select("bucket", "feature", "ks_statistic", p.alias("p_value"),
                    (p < F.lit(threshold)).alias("drifted"), "n_current", "n_reference")
