"""Dataset validation report, request-contract row checks, per-value checks, type inference.

Dataset report (one aggregate for all numeric rules; categorical violations by a
``left_anti``-style membership test inside the same aggregate):
* required columns that are absent (schema-level, no job);
* numeric: non-numeric values (NULL counts as non-numeric under ``strict_nulls`` — the
  reference's behaviour), below minimum, above maximum;
* categorical: values outside the allowed set;
* statistics: missing count / percentage, mean, sample std, min, max, median or distinct count;
* ``invalid_features`` = number of features with errors (the reference's "invalid_rows"),
  plus true row-level ``invalid_rows`` / ``valid_rows``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import truthy, number
from sparkfeat.operators.quality import value_counts
from sparkfeat.operators.ranking import exact_quantiles


@dataclass
class FeatureDefinition:
    feature_type: str                  # numeric | categorical
    required: bool = True
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: list | None = None


def _num(c: str) -> Column:
    return number(c)


def _fmt(v) -> str:
    return str(v)


def missing_columns(df: DataFrame, defs: dict[str, FeatureDefinition]) -> list[str]:
    """Required columns − present columns."""
    have = set(df.columns)
    return [n for n, d in defs.items() if d.required and n not in have]


def _row_violation(c: str, d: FeatureDefinition, strict_nulls: bool) -> Column:
    if d.feature_type == "numeric":
        x = _num(c)
        bad = x.isNull() if strict_nulls else (F.col(c).isNotNull() & x.isNull())
        if d.min_value is not None:
            bad = bad | truthy(x < F.lit(float(d.min_value)))
        if d.max_value is not None:
            bad = bad | truthy(x > F.lit(float(d.max_value)))
        return bad
    if d.allowed_values:
        return F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*[str(v) for v in d.allowed_values])
    return F.lit(False)


#: How many values of a column the report lists; ``quality.value_counts`` and ``invalid_values`` have all of them.
LISTED_VALUES = 100


def _category_counts(df: DataFrame, defs: dict[str, FeatureDefinition], cols: list[str], listed: int) -> dict[str, dict]:
    """Per column: distinct values, distinct invalid ones, the most frequent values with counts, the first
    invalid values. One unpivot and one count per (column, value), no Expand; a row per column reaches the driver."""
    allowed = df.sparkSession.createDataFrame([(c, [str(v) for v in defs[c].allowed_values]) for c in cols if defs[c].allowed_values],
                                              "feature string, allowed array<string>")
    counts = value_counts(df, cols).where("value is not null").join(F.broadcast(allowed), "feature", "left").select(   # a row per column
        "feature", "value", "n", F.coalesce(~F.array_contains("allowed", F.col("value")), F.lit(False)).alias("invalid"))
    w = Window.partitionBy("feature")
    ranked = counts.withColumns({"place": F.row_number().over(w.orderBy(F.desc("n"), "value")),
                                 "odd": F.row_number().over(w.orderBy(F.desc("invalid"), "value"))})
    stats = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("unique"), F.count_if("invalid").alias("bad"))
    lists = ranked.where((F.col("place") <= listed) | (F.col("invalid") & (F.col("odd") <= listed))).groupBy("feature").agg(
        F.sort_array(F.collect_list(F.when(F.col("place") <= listed, F.struct("place", "value", "n")))).alias("most"),
        F.sort_array(F.collect_list(F.when(F.col("invalid") & (F.col("odd") <= listed), F.col("value")))).alias("odd_values"))
    rows = {r["feature"]: r.asDict() for r in stats.join(lists, "feature").collect()}
    return {c: rows.get(c, {"unique": 0, "bad": 0, "most": [], "odd_values": []}) for c in cols}


def validate_dataset(df: DataFrame, defs: dict[str, FeatureDefinition],
                     strict_nulls: bool = True, listed: int = LISTED_VALUES) -> tuple[DataFrame, DataFrame]:
    """(per-feature report, one-row dataset summary). Medians are exact. A categorical column's report has its values with
    their counts, most frequent first (``value_counts``: "value=count, ..."), and the invalid values themselves, the first
    ``listed`` of either."""
    present = [n for n in defs if n in df.columns]
    numeric = [n for n in present if defs[n].feature_type == "numeric"]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, n in enumerate(present):
        d = defs[n]
        col = F.col(n)
        aggs += [F.count_if(col.isNull()).alias(f"miss{i}")]
        if d.feature_type == "numeric":
            x = _num(n)
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                     (F.count(x) < (F.count(F.lit(1)) if strict_nulls else F.count(col))).alias(f"nonnum{i}")]
    texts = [n for n in present if n not in numeric]
    categories = _category_counts(df, defs, texts, listed) if texts else {}
    aggs.append(F.count_if(F.lit(False) if not present else
                           _any([_row_violation(n, defs[n], strict_nulls) for n in present]))
                .alias("_invalid_rows"))
    row = df.agg(*aggs)
    structs = []
    n_err = F.lit(0)
    for i, n in enumerate(present):
        d = defs[n]
        miss = F.col(f"miss{i}")
        pct = F.try_divide(miss * 100.0, F.col("_rows"))
        if d.feature_type == "numeric":
            # The error texts are output texts of the reference.
            errs = [F.when(F.col(f"nonnum{i}"), F.lit("Contains non-numeric values"))]
            below = truthy(F.col(f"min{i}") < F.lit(float(d.min_value))) if d.min_value is not None else F.lit(False)
            above = truthy(F.col(f"max{i}") > F.lit(float(d.max_value))) if d.max_value is not None else F.lit(False)
            errs += [F.when(below, F.lit(f"Values below minimum ({_fmt(d.min_value)})")),
                     F.when(above, F.lit(f"Values above maximum ({_fmt(d.max_value)})"))]
            med = F.lit(None).cast("double")
            stats = [F.col(f"mean{i}"), F.col(f"std{i}"), F.col(f"min{i}"), F.col(f"max{i}"),
                     med, F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), *[F.lit(None).cast("string")] * 2]
        else:
            c = categories[n]
            odd = ", ".join(c["odd_values"]) + (f" and {c['bad'] - listed} more" if c["bad"] > listed else "")
            errs = [F.when(F.lit(c["bad"] > 0), F.lit(f"Contains invalid values: {odd}"))]
            stats = [F.lit(None).cast("double")] * 5 + [F.lit(c["unique"]).cast("bigint"), F.lit(c["bad"]).cast("bigint"),
                     F.lit(", ".join(f"{m['value']}={m['n']}" for m in c["most"])), F.lit(odd)]
        names = ["mean", "std", "min", "max", "median", "unique_values", "invalid_value_count", "value_counts", "invalid_values"]
        err = F.filter(F.array(*errs), lambda e: e.isNotNull())
        n_err = n_err + (F.size(err) > 0).cast("int")
        structs.append(F.struct(
            F.lit(n).alias("feature"), F.lit(d.feature_type).alias("feature_type"),
            miss.alias("missing_count"), pct.alias("missing_pct"),
            *[s.alias(nm) for s, nm in zip(stats, names)],
            (F.size(err) > 0).alias("has_errors"), F.array_join(err, "; ").alias("errors")))
    per_feature = row.select(F.inline(F.array(*structs))) if structs else None
    if per_feature is not None and numeric:
        # exact medians ranked with distributed running sums; one row per numeric column
        med = exact_quantiles(df, numeric, [0.5]).select("feature", F.col("quantile").alias("_med"))
        cols = per_feature.columns
        per_feature = per_feature.join(F.broadcast(med), "feature", "left").select(
            *[F.coalesce("_med", "median").alias("median") if c == "median" else F.col(c)
              for c in cols])
    miss_cols = missing_columns(df, defs)
    summary = row.select(
        F.col("_rows").alias("total_rows"),
        F.lit(",".join(miss_cols)).alias("missing_columns"),
        F.col("_invalid_rows").alias("invalid_rows"),
        (F.col("_rows") - F.col("_invalid_rows")).alias("valid_rows"),
        (n_err + F.lit(1 if miss_cols else 0)).cast("bigint").alias("invalid_features"))
    return per_feature, summary


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def invalid_values(df: DataFrame, defs: dict[str, FeatureDefinition]) -> DataFrame:
    """Observed − allowed values per categorical feature, with counts (distributed)."""
    cats = [n for n, d in defs.items() if n in df.columns and d.feature_type != "numeric"
            and d.allowed_values]
    if not cats:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                 F.col(c).cast("string").alias("value")) for c in cats])))
    allowed = df.sparkSession.createDataFrame(
        [(c, str(v)) for c in cats for v in defs[c].allowed_values], "feature string, value string")
    return (long.where(F.col("value").isNotNull())
            .join(allowed, ["feature", "value"], "left_anti")
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------------ P3
@dataclass
class RowRule:
    reason: str
    valid: Column            # NULL counts as a failure


# The reference's request contract — field patterns and bounds.
REQUEST_CONTRACT = [
    ("Pclass", "pattern", "^[123]$"),
    ("Sex", "pattern", "^(male|female)$"),
    ("Age", "range", (0, 120)),
    ("SibSp", "range", (0, None)),
    ("Parch", "range", (0, None)),
    ("Fare", "range", (0, None)),
    ("Embarked", "pattern", "^[CQS]$"),
]


def contract_rules(contract=REQUEST_CONTRACT) -> list[RowRule]:
    """Row rules from a field contract: every field is required; patterns match the whole
    text (case-sensitive); ranges are inclusive. Reasons name the field and the check."""
    rules = []
    for name, kind, arg in contract:
        c = F.col(name)
        rules.append(RowRule(f"{name}: field required", c.isNotNull()))
        if kind == "pattern":
            ok = c.isNull() | c.cast("string").rlike(arg)
            rules.append(RowRule(f"{name}: must match {arg}", ok))
        else:
            lo, hi = arg
            x = c.try_cast("double")
            ok = c.isNull() | (x.isNotNull()
                               & (F.lit(True) if lo is None else x >= F.lit(float(lo)))
                               & (F.lit(True) if hi is None else x <= F.lit(float(hi))))
            bounds = f">= {lo}" if hi is None else f"between {lo} and {hi}"
            rules.append(RowRule(f"{name}: must be a number {bounds}", ok))
    return rules


def row_reasons(rules: list[RowRule]) -> Column:
    return F.filter(F.array(*[F.when(~truthy(r.valid), F.lit(r.reason)) for r in rules]),
                    lambda x: x.isNotNull())


def split_requests(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with a ``reasons`` array) from one projection."""
    tagged = df.withColumn("reasons", row_reasons(rules))
    return (tagged.where(F.size("reasons") == 0).drop("reasons"),
            tagged.where(F.size("reasons") > 0))


# ------------------------------------------------------------------------ P4
@dataclass
class ValueDeclaration:
    feature_type: str
    min_value: float | None = None
    max_value: float | None = None
    categories: list[str] | None = None


def value_is_valid(feature: Column, value: Column, decls: dict[str, ValueDeclaration]) -> Column:
    """Value (as text) vs its feature's declaration; undeclared features pass.

    The declared type must parse (numeric and float: a number; integer: a whole number; string
    and categorical: any text); bounds compare as numbers and categories as texts, whatever the
    type; a declaration without categories allows all. What cannot be compared (NULL,
    unparsable under bounds) is False."""
    expr = F.lit(True)
    x = number(value)
    for name, d in reversed(list(decls.items())):
        ok = value.isNotNull()
        if d.feature_type in ("numeric", "float"):
            ok = ok & x.isNotNull()
        elif d.feature_type == "integer":
            ok = ok & (x == F.floor(x))
        if d.min_value is not None:
            ok = ok & (x >= F.lit(float(d.min_value)))
        if d.max_value is not None:
            ok = ok & (x <= F.lit(float(d.max_value)))
        if d.categories is not None:
            ok = ok & value.cast("string").isin(*[str(c) for c in d.categories])
        expr = F.when(feature == F.lit(name), truthy(ok)).otherwise(expr)
    return expr


# ------------------------------------------------------------------------ S2
def infer_string_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: numeric when every non-NULL value parses as a number, else string.
    One aggregate; rows never leave the executors."""
    cols = cols or df.columns
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.count(F.col(c).cast("string").try_cast("double")).alias(f"p{i}")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.when(F.col(f"n{i}") == F.col(f"p{i}"), F.lit("numeric")).otherwise(F.lit("string")).alias("inferred_type"),
        F.col(f"n{i}").alias("non_null"), F.col(f"p{i}").alias("parsed")) for i, c in enumerate(cols)])))


def apply_inferred_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c, t in types.items() if t == "numeric"})
