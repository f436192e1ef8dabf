"""Data-quality rules and column profiles (one aggregate pass per table).

Reference semantics reproduced here:
* a rule's pass rate is the mean of a boolean mask over *all* rows, NULL compares False;
* the overall score is the unweighted mean of the rule pass rates;
* a column is invalid when more than 20 % of it is missing; numeric columns also when
  ``|mean| > 1e10``; categorical columns also when they have more than 100 values;
* pandas ``std`` is the sample deviation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import as_col, is_missing, number, pass_rate, truthy
from sparkfeat.operators.ranking import exact_quantiles

# Fixed thresholds of the reference validators.
MAX_MISSING_RATE = 0.2
MAX_ABS_MEAN = 1e10
MAX_CATEGORIES = 100
TOP_K = 5


def _explode_structs(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregate row of per-feature structs → one row per feature."""
    return df.select(F.inline(F.array(*structs)))


def _missing_reason(missing_rate: Column, limit: float) -> Column:
    # This and the other reason texts of this module are output texts of the reference.
    return F.when(missing_rate > F.lit(limit), F.format_string(
        "High missing rate: %.2f", F.round(missing_rate, 2)))


def _reasons(*parts: Column) -> Column:
    """Array of the non-NULL reason strings, joined with '; ' ('' when valid)."""
    return F.concat_ws("; ", F.filter(F.array(*parts), lambda x: x.isNotNull()))


# The reference's five request-quality rules (name → predicate over the
# passenger columns); pass them to ``rule_pass_rates`` for tables with those columns.
PASSENGER_RULES = {
    "Age not null": "Age IS NOT NULL",
    "Age between 0 and 120": "Age >= 0 AND Age <= 120",
    "Sex in [male, female]": "Sex IN ('male', 'female')",
    "Fare >= 0": "Fare >= 0",
    "Pclass in [1, 2, 3]": "Pclass IN (1, 2, 3)",
}


# --------------------------------------------------------------------------- A9
def rule_pass_rates(df: DataFrame, rules: Mapping[str, Column | str],
                    overall_name: str = "overall") -> DataFrame:
    """Pass rate of every named rule plus the overall score, in one aggregate.

    Output: ``rule string, pass_rate double``; NULL predicates fail.
    """
    names = list(rules)
    if not names:
        raise ValueError("at least one rule is required")
    aggs = [pass_rate(as_col(rules[n])).alias(f"r{i}") for i, n in enumerate(names)]
    row = df.agg(*aggs)
    overall = sum((F.col(f"r{i}") for i in range(len(names))), F.lit(0.0)) / F.lit(float(len(names)))
    structs = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("pass_rate"))
               for i, n in enumerate(names)]
    structs.append(F.struct(F.lit(overall_name).alias("rule"), overall.alias("pass_rate")))
    return _explode_structs(row, structs)


# --------------------------------------------------------------------------- A4
def numeric_quality(df: DataFrame, cols: list[str], max_missing: float = MAX_MISSING_RATE,
                    max_abs_mean: float = MAX_ABS_MEAN) -> DataFrame:
    """mean, sample std, min, max, missing_rate, valid, reasons per numeric column."""
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 pass_rate(is_missing(c, df.schema[c].dataType)).alias(f"miss{i}")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        mean, miss = F.col(f"mean{i}"), F.col(f"miss{i}")
        extreme = truthy(F.abs(mean) > F.lit(max_abs_mean))
        reasons = _reasons(_missing_reason(miss, max_missing),
                           F.when(extreme, F.concat(F.lit("Extreme mean value: "),
                                                    mean.cast("string"))))
        structs.append(F.struct(
            F.lit(c).alias("feature"), mean.alias("mean"), F.col(f"std{i}").alias("std"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
            miss.alias("missing_rate"),
            (~(truthy(miss > F.lit(max_missing)) | extreme)).alias("valid"),
            reasons.alias("reasons")))
    return _explode_structs(row, structs)


# --------------------------------------------------------------------------- helpers
def unpivot_values(df: DataFrame, cols: list[str], value_type: str = "string") -> DataFrame:
    """(feature, value) rows for the given columns, NULLs kept."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value"))
        for c in cols])))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n) for every column; map-side combined by the aggregate."""
    return unpivot_values(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _share() -> Column:
    """Share of a value among the non-NULL rows, NULL for the NULL value. A filter on it needs both
    sides of the join, so it is not pushed into one copy of the counts and they are read once."""
    return F.when(F.col("value").isNotNull(), F.col("n") / (F.col("total") - F.col("missing")))


def _feature_totals(counts: DataFrame) -> DataFrame:
    """Rows and NULLs per feature: one row per column, so always small enough to broadcast."""
    return counts.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


def top_values(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k non-NULL values per feature by count desc, value asc.

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task keeps only its
    own k best rows per feature before the shuffle, so a hot feature costs k rows.
    """
    # NULL values rank after every real value and are dropped after ranking; filtering
    # them first would push the filter under the count aggregate and stop the shuffle of
    # ``counts`` from being reused by the other consumers of the same counts.
    w = Window.partitionBy("feature").orderBy(F.col("value").isNull().asc(), F.desc("n"),
                                              F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") <= k) & F.col("value").isNotNull()))


def _join_ranked(text: Column) -> Column:
    """Aggregate: texts of the ranked rows, in rank order, joined with ', '."""
    return F.concat_ws(", ", F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), text.alias("t")))),
        lambda s: s["t"]))


# --------------------------------------------------------------------------- A5 / O4
def categorical_quality(df: DataFrame, cols: list[str], max_missing: float = MAX_MISSING_RATE,
                        max_categories: int = MAX_CATEGORIES, k: int = TOP_K) -> DataFrame:
    """unique_values, top-k 'value:count' list, missing_rate, valid, reasons per column."""
    counts = value_counts(df, cols)
    summary = counts.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique_values"))
    top = top_values(counts, k).groupBy("feature").agg(
        _join_ranked(F.concat(F.col("value"), F.lit(":"), F.col("n").cast("string")))
        .alias("top_values"))
    miss = F.col("missing") / F.col("total")
    return (summary.join(top, "feature", "left")
            .select("feature", "unique_values",
                    F.coalesce(F.col("top_values"), F.lit("")).alias("top_values"),
                    miss.alias("missing_rate"),
                    (~((miss > F.lit(max_missing)) |
                       (F.col("unique_values") > F.lit(max_categories)))).alias("valid"),
                    _reasons(_missing_reason(miss, max_missing),
                             F.when(F.col("unique_values") > F.lit(max_categories),
                                    F.format_string("Too many unique values: %d",
                                                    F.col("unique_values")))).alias("reasons")))


# --------------------------------------------------------------------------- A6
def timestamp_quality(df: DataFrame, cols: list[str], max_missing: float = MAX_MISSING_RATE
                      ) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                 pass_rate(F.col(c).isNull()).alias(f"miss{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(
        F.lit(c).alias("feature"),
        F.date_format(F.col(f"lo{i}"), "yyyy-MM-dd HH:mm:ss").alias("min_date"),
        F.date_format(F.col(f"hi{i}"), "yyyy-MM-dd HH:mm:ss").alias("max_date"),
        F.col(f"miss{i}").alias("missing_rate"),
        (~truthy(F.col(f"miss{i}") > F.lit(max_missing))).alias("valid"),
        _reasons(_missing_reason(F.col(f"miss{i}"), max_missing)).alias("reasons"))
        for i, c in enumerate(cols)]
    return _explode_structs(row, structs)


def boolean_quality(df: DataFrame, cols: list[str], max_missing: float = MAX_MISSING_RATE
                    ) -> DataFrame:
    """Share of each non-NULL value (normalised value counts) with the column missing rate."""
    counts = value_counts(df, cols)
    return (counts.join(F.broadcast(_feature_totals(counts)), "feature")
            .withColumn("share", _share()).where(F.col("share").isNotNull())
            .select("feature", "value", "share",
                    (F.col("missing") / F.col("total")).alias("missing_rate"),
                    (F.col("missing") / F.col("total") <= F.lit(max_missing)).alias("valid")))


def text_quality(df: DataFrame, cols: list[str], max_missing: float = MAX_MISSING_RATE
                 ) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        ln = F.char_length(F.col(c))
        aggs += [F.avg(ln).alias(f"avg{i}"), F.max(ln).alias(f"max{i}"),
                 pass_rate(F.col(c).isNull()).alias(f"miss{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(
        F.lit(c).alias("feature"), F.col(f"avg{i}").alias("avg_length"),
        F.col(f"max{i}").cast("bigint").alias("max_length"),
        F.col(f"miss{i}").alias("missing_rate"),
        (~truthy(F.col(f"miss{i}") > F.lit(max_missing))).alias("valid"),
        _reasons(_missing_reason(F.col(f"miss{i}"), max_missing)).alias("reasons"))
        for i, c in enumerate(cols)]
    return _explode_structs(row, structs)


# --------------------------------------------------------------------------- A8
def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """min, max, mean, exact median, sample std per numeric column; NaN counts as missing."""
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}")]
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
                        F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std")) for i, c in enumerate(cols)]
    medians = exact_quantiles(df, cols, [0.5]).select("feature", F.col("quantile").alias("median"))
    # one row per column on both sides
    return (_explode_structs(df.agg(*aggs), structs).join(F.broadcast(medians), "feature", "left")
            .select("feature", "min", "max", "mean", "median", "std"))


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Category list with its normalised distribution (share among non-NULL rows)."""
    counts = value_counts(df, cols)
    return (counts.join(F.broadcast(_feature_totals(counts)), "feature")
            .withColumn("share", _share()).where(F.col("share").isNotNull())
            .select("feature", F.col("value").alias("category"), "n", "share"))
