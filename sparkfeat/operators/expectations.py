"""Expectation suites, evaluated in one aggregate beside a few jobs that several expectations share.

Suite shape (JSON-compatible): ``{column: [{"type": name, "params": {...}}], "_dataframe_": [...]}``.
Column-value expectations ignore NULLs (except those about NULL itself) and report the number of
unexpected values; with ``mostly`` they hold if that share of the values they look at is as expected (no values:
they hold). Aggregate expectations report the statistic. Unknown expectation names are ignored, absent
columns skipped, and an expectation that fails to build counts as a failure with its error text.

What one aggregate cannot tell is found before it, once for all expectations that need it: distinct
values (one unpivot and one count per column and value, no Expand), exact quantiles, order (ranges of the order
column; neighbours within a range and across the edges of ranges), repeated combinations of columns, and
the shares of stated bins.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import number
from sparkfeat.operators.ranking import exact_quantiles
from sparkfeat.session import ensure_checkpoint_dir

TABLE = "_dataframe_"


def _between(x: Column, p: dict) -> Column:
    ok = F.lit(True)
    if p.get("min_value") is not None:
        ok = ok & (x >= F.lit(p["min_value"]))
    if p.get("max_value") is not None:
        ok = ok & (x <= F.lit(p["max_value"]))
    return ok


# Each builder returns (observed aggregate, unexpected-count aggregate or None, success expr
# over the observed value ``o``, unexpected count ``u`` and number of values looked at ``t``,
# aggregate of ``t`` or None).
def _mostly(p: dict):
    share = p.get("mostly", 1.0)
    if not 0 <= share <= 1:
        raise ValueError("mostly must be between 0 and 1")
    # whole numbers up to rounding: 0.95 of 20 values is 19
    return lambda o, u, t: (u == 0) if share == 1 else (t - u >= F.lit(float(share)) * t - 1e-9)


def _values(cond: Callable[[Column, dict], Column]):
    def build(c: Column, p: dict):
        bad = F.count_if(c.isNotNull() & ~F.coalesce(cond(c, p), F.lit(False)))
        return bad.cast("double"), bad, _mostly(p), F.count(c)
    return build


def _stat(agg: Callable[[Column], Column]):
    def build(c: Column, p: dict):
        o = agg(number(c)).cast("double")         # text that is no number is skipped, not an error
        return o, None, lambda o_, u, t: F.coalesce(_between(o_, p), F.lit(False)), None
    return build


def _null(wanted: bool):
    def build(c: Column, p: dict):
        bad = F.count_if(c.isNotNull() if wanted else c.isNull())
        return bad.cast("double"), bad, _mostly(p), F.count(F.lit(1))
    return build


def _pattern(matches: bool):
    def build(c: Column, p: dict):
        re.compile(p["regex"])                    # an invalid pattern is this expectation's failure alone
        hit = lambda x, q: x.cast("string").rlike(q["regex"])
        return _values(hit if matches else lambda x, q: ~hit(x, q))(c, p)
    return build


def _length(c: Column, p: dict) -> Column:
    n = F.length(c.cast("string"))
    return n == F.lit(p["value"]) if "value" in p else _between(n, p)


def _texts(p: dict, key: str = "value_set") -> list[str]:
    return [str(v) for v in p.get(key, [])]


COLUMN_EXPECTATIONS: dict[str, Callable] = {
    "column_values_to_be_null": _null(True),
    "column_values_to_not_be_null": _null(False),
    "column_values_to_be_between": _values(lambda c, p: _between(number(c), p)),
    "column_values_to_be_in_set": _values(lambda c, p: c.cast("string").isin(*_texts(p))),
    "column_values_to_not_be_in_set": _values(lambda c, p: ~c.cast("string").isin(*_texts(p))),
    "column_values_to_match_regex": _pattern(True),
    "column_values_to_not_match_regex": _pattern(False),
    "column_value_lengths_to_be_between": _values(_length),
    "column_value_lengths_to_equal": _values(_length),
    "column_min_to_be_between": _stat(F.min),
    "column_max_to_be_between": _stat(F.max),
    "column_mean_to_be_between": _stat(F.avg),
    "column_stdev_to_be_between": _stat(F.stddev_samp),
    "column_sum_to_be_between": _stat(F.sum),
}


def _row_count(df: DataFrame, p: dict):
    o = F.count(F.lit(1)).cast("double")
    return o, None, lambda o_, u, t: (o_ == F.lit(float(p["value"]))) if "value" in p else _between(o_, p), None


def _columns_match(df: DataFrame, p: dict):
    want = list(p.get("column_set", []))
    exact = p.get("exact_match", True)
    ok = (set(want) == set(df.columns)) if exact else set(want).issubset(df.columns)
    return F.lit(float(len(df.columns))), None, lambda o_, u, t: F.lit(ok), None


def _column_count(df: DataFrame, p: dict):
    return F.lit(float(len(df.columns))), None, lambda o_, u, t: F.lit(len(df.columns) == p["value"]), None


def _rows(columns: Callable[[dict], list[str]], cond: Callable[[list[Column], dict], Column]):
    """A condition on several columns of a row; rows in which all of them are NULL are not looked at."""
    def build(df: DataFrame, p: dict):
        cols = [F.col(f"`{c}`") for c in columns(p)]
        looked = ~functools.reduce(lambda a, b: a & b, [c.isNull() for c in cols])
        bad = F.count_if(looked & ~F.coalesce(cond(cols, p), F.lit(False)))
        return bad.cast("double"), bad, _mostly(p), F.count_if(looked)
    return build


def _pair(p: dict) -> list[str]:
    return [p["column_A"], p["column_B"]]


def _greater(cols: list[Column], p: dict) -> Column:
    return cols[0] >= cols[1] if p.get("or_equal") else cols[0] > cols[1]


def _sum_equals(cols: list[Column], p: dict) -> Column:
    return F.abs(functools.reduce(lambda a, b: a + b, [number(c) for c in cols]) - F.lit(float(p["sum_total"]))) <= 1e-9


def _all_differ(cols: list[Column], p: dict) -> Column:
    return F.size(F.array_distinct(F.array(*[c.cast("string") for c in cols]))) == len(cols)


TABLE_EXPECTATIONS: dict[str, Callable] = {
    "table_row_count_to_be_between": _row_count,
    "table_row_count_to_equal": _row_count,
    "table_columns_to_match_set": _columns_match,
    "table_column_count_to_equal": _column_count,
    "column_pair_values_to_be_equal": _rows(_pair, lambda c, p: c[0] == c[1]),
    "column_pair_values_a_to_be_greater_than_b": _rows(_pair, _greater),
    "multicolumn_sum_to_equal": _rows(lambda p: p["column_list"], _sum_equals),
    "select_column_values_to_be_unique_within_record": _rows(lambda p: p["column_list"], _all_differ),
}


# ------------------------------------------------------------------------ found before the aggregate
def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Per column: distinct values, rows with a value, rows whose value occurs again. One unpivot and one count
    per (column, value); one row per column reaches the driver."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])))
    per = long.where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("c").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"),
                                F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"),
                                F.max_by("v", F.struct(F.col("n"), F.col("v"))).alias("top")).collect()
    return {c: {"distinct": 0, "rows": 0, "again": 0, "top": None} for c in cols} | {r["c"]: r.asDict() for r in rows}


def compound_repeats(df: DataFrame, cols: list[str]) -> tuple[int, int]:
    """(rows whose combination of values occurs again, rows looked at); rows without any value are not."""
    some = functools.reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in cols])
    per = df.where(some).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    r = per.agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("again"), F.sum("_n").alias("rows")).first()
    return r["again"] or 0, r["rows"] or 0


def order_breaks(df: DataFrame, value: str, order: list[str], falling: bool = False, strictly: bool = False) -> tuple[int, int]:
    """(values that do not follow the one before them, values) along ``order``; NULL values are passed over. Rows
    are dealt by ranges of the order; a range compares its neighbours, and the ends of ranges, one row each, are compared
    after that. Rows of one order are compared by value."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = [F.col(f"`{c}`") for c in order]
    rows = (df.where(F.col(f"`{value}`").isNotNull()).select(F.struct(*by).alias("o"), F.col(f"`{value}`").alias("v"))
            .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o", "v")
            .withColumn("part", F.spark_partition_id()).checkpoint())
    step = F.desc("v") if falling else F.asc("v")
    tie = -F.col("v") if falling and df.schema[value].dataType.typeName() in _NUMBERS else F.col("v")
    breaks = lambda before, after: ((after >= before) if strictly else (after > before)) if falling else ((after <= before) if strictly else (after < before))
    w = Window.partitionBy("part").orderBy("o", step)
    inner = rows.withColumn("b", F.lag("v").over(w)).groupBy("part").agg(
        F.count_if(breaks(F.col("b"), F.col("v"))).alias("bad"), F.count(F.lit(1)).alias("n"),
        F.min_by("v", F.struct("o", tie)).alias("first"), F.max_by("v", F.struct("o", tie)).alias("last"))
    # one row per range
    edge = inner.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    r = edge.agg(F.sum(F.col("bad") + F.coalesce(breaks(F.col("before"), F.col("first")).cast("long"), F.lit(0))).alias("bad"), F.sum("n").alias("n")).first()
    return r["bad"] or 0, r["n"] or 0


_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def bin_counts(df: DataFrame, column: str, p: dict) -> list[int]:
    """Values in each stated bin ([a, b), the last one closed) or of each stated value, then those in none."""
    c = F.col(f"`{column}`")
    if "bins" in p:
        x, edges = number(c), p["bins"]
        inside = [(x >= a) & ((x <= b) if i == len(edges) - 2 else (x < b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        there = x.isNotNull()
    else:
        inside, there = [c.cast("string") == v for v in _texts(p, "values")], c.isNotNull()
    none = there & ~F.coalesce(functools.reduce(lambda a, b: a | b, inside), F.lit(False))
    row = df.agg(*[F.count_if(i).alias(f"b{k}") for k, i in enumerate(inside)], F.count_if(none).alias("none")).first()
    return list(row)


def divergence(counts: list[int], weights: list[float], outside: float = 0.0) -> float | None:
    """Kullback-Leibler divergence in nats of the counted shares from the stated ones; None if it is infinite, that
    is if something is counted where nothing is stated."""
    total, stated = sum(counts), [*weights, outside]
    if abs(sum(stated) - 1) > 1e-6 or any(w < 0 for w in stated):
        raise ValueError("weights must sum to 1")
    if any(n and not w for n, w in zip(counts, stated, strict=True)):
        return None
    return sum(n / total * math.log(n / total / w) for n, w in zip(counts, stated, strict=True) if n) if total else 0.0


def _known(observed: float | None, unexpected: int | None, success: bool):
    return lambda *_: (F.lit(observed).cast("double"), None if unexpected is None else F.lit(unexpected).cast("long"),
                       lambda o, u, t: F.lit(bool(success)), None)


def _inside(x: float | None, p: dict) -> bool:
    return x is not None and (p.get("min_value") is None or x >= p["min_value"]) and (p.get("max_value") is None or x <= p["max_value"])


def _enough(bad: int, rows: int, p: dict) -> bool:
    return bad == 0 or rows - bad >= p.get("mostly", 1.0) * rows - 1e-9


#: Answered from the counts of distinct values: (name, column's counts, params) → (observed, unexpected, success).
DISTINCT_EXPECTATIONS: dict[str, Callable[[dict, dict], tuple]] = {
    "column_values_to_be_unique": lambda d, p: (float(d["rows"] - d["distinct"]), d["rows"] - d["distinct"], _enough(d["rows"] - d["distinct"], d["rows"], p)),
    "column_unique_value_count_to_be_between": lambda d, p: (float(d["distinct"]), None, _inside(d["distinct"], p)),
    "column_proportion_of_unique_values_to_be_between":
        lambda d, p: (d["distinct"] / d["rows"] if d["rows"] else None, None, _inside(d["distinct"] / d["rows"] if d["rows"] else None, p)),
    "column_most_common_value_to_be_in_set": lambda d, p: (None, None, d["top"] in _texts(p)),
}
#: Answered by jobs of their own.
ORDER_EXPECTATIONS = {"column_values_to_be_increasing": False, "column_values_to_be_decreasing": True}
SHARED = {*DISTINCT_EXPECTATIONS, *ORDER_EXPECTATIONS, "column_median_to_be_between", "column_quantile_values_to_be_between",
          "column_kl_divergence_to_be_less_than", "column_distinct_values_to_be_in_set", "column_distinct_values_to_contain_set"}
SHARED_TABLE = {"compound_columns_to_be_unique"}


class ExpectationSuite:
    def __init__(self, expectations: dict | None = None):
        self.expectations: dict[str, list[dict]] = expectations or {}

    def add(self, column: str, expectation_type: str, **params) -> ExpectationSuite:
        self.expectations.setdefault(column, []).append({"type": expectation_type, "params": params})
        return self

    def to_json(self) -> str:
        return json.dumps(self.expectations, indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> ExpectationSuite:
        return ExpectationSuite(json.loads(text))

    def _shared(self, df: DataFrame):
        """What several expectations need, each found once: (distinct counts, quantiles)."""
        named = [(c, e["type"], e.get("params", {})) for c, exps in self.expectations.items() if c in df.columns for e in exps]
        cols = sorted({c for c, n, _ in named if n in DISTINCT_EXPECTATIONS})
        probs = {(c, 0.5) for c, n, _ in named if n == "column_median_to_be_between"}
        probs |= {(c, float(q)) for c, n, p in named if n == "column_quantile_values_to_be_between" for q in p.get("quantiles", [])}
        quantiles = {}
        if probs:
            found = exact_quantiles(df, sorted({c for c, _ in probs}), sorted({q for _, q in probs})).collect()
            quantiles = {(r["feature"], r["p"]): r["quantile"] for r in found}
        return distinct_counts(df, cols) if cols else {}, quantiles

    def _builder(self, df: DataFrame, column: str, name: str, params: dict, shared) -> Callable | None:
        """The expectation's builder, None if its name or column is unknown; may run a job of its own."""
        if column == TABLE:
            if name == "compound_columns_to_be_unique":
                bad, rows = compound_repeats(df, params["column_list"])
                return _known(float(bad), bad, _enough(bad, rows, params))
            return TABLE_EXPECTATIONS.get(name)
        if column not in df.columns:
            return None
        distinct, quantiles = shared
        if name in DISTINCT_EXPECTATIONS:
            return _known(*DISTINCT_EXPECTATIONS[name](distinct[column], params))
        if name == "column_median_to_be_between":
            return _stat(lambda c, v=quantiles.get((column, 0.5)): F.lit(v).cast("double"))
        if name == "column_quantile_values_to_be_between":
            got = [quantiles.get((column, float(q))) for q in params["quantiles"]]
            ok = [_inside(x, {"min_value": lo, "max_value": hi}) for x, (lo, hi) in zip(got, params["value_ranges"], strict=True)]
            return _known(float(ok.count(False)), ok.count(False), all(ok))
        if name in ORDER_EXPECTATIONS:
            bad, rows = order_breaks(df, column, params["order_by"], ORDER_EXPECTATIONS[name], params.get("strictly", False))
            return _known(float(bad), bad, _enough(bad, rows, params))
        if name == "column_kl_divergence_to_be_less_than":
            d = divergence(bin_counts(df, column, params), params["weights"], params.get("outside", 0.0))
            return _known(d, None, d is not None and d < params["threshold"])
        if name in ("column_distinct_values_to_be_in_set", "column_distinct_values_to_contain_set"):
            wanted, seen = set(_texts(params)), F.col(f"`{column}`").cast("string")
            if name == "column_distinct_values_to_be_in_set":
                odd = df.where(seen.isNotNull() & ~seen.isin(*wanted)).select(seen).distinct().count()
            else:
                odd = len(wanted) - df.where(seen.isin(*wanted)).select(seen).distinct().count()
            return _known(float(odd), odd, odd == 0)
        return COLUMN_EXPECTATIONS.get(name)

    def validate(self, df: DataFrame) -> DataFrame:
        """One row per evaluated expectation: column, expectation, success, observed,
        unexpected_count, error."""
        items = []
        shared = self._shared(df)
        for column, exps in self.expectations.items():
            for e in exps:
                name, params = e["type"], e.get("params", {})
                try:
                    builder = self._builder(df, column, name, params, shared)
                    if builder is None:
                        continue
                    obs, unexp, ok, looked = builder(df if column == TABLE else F.col(f"`{column}`"), params)
                    df.select(*[x for x in (obs, unexp, looked) if x is not None])   # types are checked one by one
                    items.append((column, name, obs, unexp, ok, looked, None))
                except Exception as exc:  # noqa: BLE001 — a broken expectation is a failure
                    items.append((column, name, None, None, None, None, str(exc)))
        aggs = []
        for i, (_, _, obs, unexp, _, looked, err) in enumerate(items):
            if err is None:
                aggs.append(obs.alias(f"o{i}"))
                aggs += [] if unexp is None else [unexp.alias(f"u{i}")]
                aggs += [] if looked is None else [looked.alias(f"t{i}")]
        # a known number is no aggregate: with no other, one row is all that is needed
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs) if aggs else df.sparkSession.range(1)
        structs = []
        for i, (column, name, obs, unexp, ok, looked, err) in enumerate(items):
            if err is not None:
                structs.append(F.struct(F.lit(column).alias("column"), F.lit(name).alias("expectation"),
                                        F.lit(False).alias("success"), F.lit(None).cast("double").alias("observed"),
                                        F.lit(None).cast("bigint").alias("unexpected_count"),
                                        F.lit(err).alias("error")))
                continue
            o = F.col(f"o{i}")
            u = F.col(f"u{i}") if unexp is not None else F.lit(None).cast("bigint")
            t = F.col(f"t{i}") if looked is not None else F.lit(None).cast("bigint")
            structs.append(F.struct(F.lit(column).alias("column"), F.lit(name).alias("expectation"),
                                    F.coalesce(ok(o, u, t), F.lit(False)).alias("success"),
                                    o.alias("observed"), u.cast("bigint").alias("unexpected_count"),
                                    F.lit(None).cast("string").alias("error")))
        if not structs:
            return df.sparkSession.createDataFrame(
                [], "column string, expectation string, success boolean, observed double, "
                    "unexpected_count bigint, error string")
        return row.select(F.inline(F.array(*structs)))
