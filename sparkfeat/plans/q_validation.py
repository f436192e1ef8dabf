"""Catalogue: dataset validation, request contract, value checks, type inference,
expectations (A7 U1 U2 S2 P3 P4 A10 X3 F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import round6
from sparkfeat.operators import validation as V
from sparkfeat.operators.expectations import ExpectationSuite
from sparkfeat.plans.registry import Tables, register

DEFS = {
    "o_totalprice": V.FeatureDefinition("numeric", min_value=1000, max_value=400000),
    "o_custkey": V.FeatureDefinition("numeric", min_value=0, max_value=1000),
    "mixed": V.FeatureDefinition("numeric"),
    "o_orderstatus": V.FeatureDefinition("categorical", allowed_values=["F", "O"]),
    "o_orderpriority": V.FeatureDefinition("categorical", allowed_values=[
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    "o_comment": V.FeatureDefinition("numeric", required=True),
}
_FRAME = ["o_totalprice", "o_custkey",
          "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS STRING) ELSE o_orderpriority END AS mixed",
          "o_orderstatus", "o_orderpriority"]
_FRAME_SQL = "(SELECT " + ", ".join(_FRAME).replace("AS STRING", "AS VARCHAR") + " FROM orders)"


def _frame(t):
    return t.orders.selectExpr(*_FRAME)


def _num_row(name, lo, hi):
    x = f"TRY_CAST({name} AS DOUBLE)"
    errs = [f"CASE WHEN count({x}) < count(*) THEN 'Contains non-numeric values' END"]
    if lo is not None:
        errs.append(f"CASE WHEN min({x}) < {lo} THEN 'Values below minimum ({lo})' END")
    if hi is not None:
        errs.append(f"CASE WHEN max({x}) > {hi} THEN 'Values above maximum ({hi})' END")
    err = f"concat_ws('; ', {', '.join(errs)})"
    return (f"SELECT '{name}' AS feature, 'numeric' AS feature_type, count(*) FILTER (WHERE {name} IS NULL) AS missing_count, "
            f"round(count(*) FILTER (WHERE {name} IS NULL) * 100.0 / count(*), 6) AS missing_pct, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
            f"round(quantile_cont({x}, 0.5), 6) AS median, CAST(NULL AS DOUBLE) AS unique_values, CAST(0 AS BIGINT) AS invalid_value_count, "
            f"CAST(NULL AS VARCHAR) AS value_counts, CAST(NULL AS VARCHAR) AS invalid_values, "
            f"{err} <> '' AS has_errors, {err} AS errors FROM t")


def _cat_row(name, allowed):
    lst = ", ".join(f"'{v}'" for v in allowed)
    bad = f"CASE WHEN {name} IS NOT NULL AND {name} NOT IN ({lst}) THEN {name} END"
    inv = f"count(DISTINCT {bad})"
    odd = f"coalesce(string_agg(DISTINCT {bad}, ', ' ORDER BY {bad}), '')"
    counts = (f"(SELECT string_agg(v || '=' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, v) FROM "
              f"(SELECT {name} AS v, count(*) AS n FROM t WHERE {name} IS NOT NULL GROUP BY 1))")
    return (f"SELECT '{name}', 'categorical', count(*) FILTER (WHERE {name} IS NULL), "
            f"round(count(*) FILTER (WHERE {name} IS NULL) * 100.0 / count(*), 6), NULL, NULL, NULL, NULL, NULL, "
            f"CAST(count(DISTINCT {name}) AS DOUBLE), {inv}, {counts}, {odd}, {inv} > 0, "
            f"CASE WHEN {inv} > 0 THEN 'Contains invalid values: ' || {odd} ELSE '' END FROM t")


_REPORT_SQL = (f"WITH t AS {_FRAME_SQL} " + " UNION ALL ".join([
    _num_row("o_totalprice", 1000, 400000), _num_row("o_custkey", 0, 1000), _num_row("mixed", None, None),
    _cat_row("o_orderstatus", ["F", "O"]),
    _cat_row("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])]))

_ROUND = ["missing_pct", "mean", "std", "min", "max", "median"]


@register("validation_report", _REPORT_SQL, "A7 U1")
def validation_report(spark, sf_dir):
    per_feature, _ = V.validate_dataset(_frame(Tables(spark, sf_dir)), DEFS)
    # NULL for numeric features: carried as double so both engines agree on the type
    return per_feature.withColumns({c: round6(F.col(c)) for c in _ROUND}).withColumn(
        "unique_values", F.col("unique_values").cast("double"))


_ROW_BAD = """(TRY_CAST(o_totalprice AS DOUBLE) IS NULL OR o_totalprice < 1000 OR o_totalprice > 400000
  OR o_custkey IS NULL OR o_custkey < 0 OR o_custkey > 1000 OR TRY_CAST(mixed AS DOUBLE) IS NULL
  OR (o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))
  OR (o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')))"""


@register("validation_summary", f"""WITH t AS {_FRAME_SQL}, r AS ({_REPORT_SQL})
SELECT count(*) AS total_rows, 'o_comment' AS missing_columns, count(*) FILTER (WHERE {_ROW_BAD}) AS invalid_rows,
  count(*) - count(*) FILTER (WHERE {_ROW_BAD}) AS valid_rows,
  (SELECT count(*) FILTER (WHERE has_errors) + 1 FROM r) AS invalid_features FROM t""", "A7 U1")
def validation_summary(spark, sf_dir):
    _, summary = V.validate_dataset(_frame(Tables(spark, sf_dir)), DEFS)
    return summary


@register("invalid_values", f"""WITH t AS {_FRAME_SQL}
SELECT 'o_orderstatus' AS feature, o_orderstatus AS value, count(*) AS n FROM t
WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus""", "U2")
def invalid_values(spark, sf_dir):
    return V.invalid_values(_frame(Tables(spark, sf_dir)), DEFS)


_RULES_SQL = [
    ("linenumber must be one of 1, 2, 3", "l_linenumber IN (1, 2, 3)"),
    ("returnflag must be one of A, R", "l_returnflag IN ('A', 'R')"),
    ("quantity must be between 1 and 40", "l_quantity BETWEEN 1 AND 40"),
    ("discount is required", "d IS NOT NULL"),
    ("discount must be >= 0.02", "d IS NULL OR d >= 0.02"),
]


def _reasons_sql():
    parts = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{r}' END" for r, c in _RULES_SQL)
    return f"concat_ws('; ', {parts})"


_REQ_SQL = f"""(SELECT l_orderkey, l_linenumber, {_reasons_sql()} AS reasons FROM (
  SELECT *, nullif(l_discount, 0.0) AS d FROM lineitem))"""


def _requests(t):
    li = t.lineitem.withColumn("d", F.expr("nullif(l_discount, 0.0)"))
    rules = [V.RowRule(r, F.expr(c)) for r, c in _RULES_SQL]
    return li.select("l_orderkey", "l_linenumber", V.row_reasons(rules).alias("reasons"))


@register("request_split", f"SELECT l_orderkey, l_linenumber, reasons = '' AS valid, reasons FROM {_REQ_SQL}", "P3")
def request_split(spark, sf_dir):
    r = _requests(Tables(spark, sf_dir))
    return r.select("l_orderkey", "l_linenumber", (F.size("reasons") == 0).alias("valid"),
                    F.array_join("reasons", "; ").alias("reasons"))


@register("request_reasons", f"""SELECT reason, count(*) AS n FROM (
  SELECT unnest(string_split(reasons, '; ')) AS reason FROM {_REQ_SQL} WHERE reasons <> '') GROUP BY reason""", "P3")
def request_reasons(spark, sf_dir):
    r = _requests(Tables(spark, sf_dir))
    return r.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


DECLS = {
    "click": V.ValueDeclaration("numeric", 0, 100),
    "purchase": V.ValueDeclaration("numeric", min_value=10),
    "signup": V.ValueDeclaration("numeric", max_value=200),
    "view": V.ValueDeclaration("categorical", categories=["1.63", "12.31"]),
}


@register("feature_value_check", """SELECT event_id, event_type AS feature, CASE
  WHEN event_type = 'click' THEN coalesce(TRY_CAST(v AS DOUBLE) >= 0 AND TRY_CAST(v AS DOUBLE) <= 100, false)
  WHEN event_type = 'purchase' THEN coalesce(TRY_CAST(v AS DOUBLE) >= 10, false)
  WHEN event_type = 'signup' THEN coalesce(TRY_CAST(v AS DOUBLE) <= 200, false)
  WHEN event_type = 'view' THEN coalesce(v IN ('1.63', '12.31'), false)
  ELSE true END AS valid FROM (SELECT *, CAST(value AS VARCHAR) AS v FROM events)""", "P4")
def feature_value_check(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select("event_id", F.col("event_type").alias("feature"),
                     V.value_is_valid(F.col("event_type"), F.col("value").cast("string"), DECLS).alias("valid"))


_INFER_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("infer_types", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CASE WHEN count({c}) = count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) THEN 'numeric' ELSE 'string' END AS inferred_type, "
    f"count({c}) AS non_null, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS parsed FROM part" for c in _INFER_COLS), "S2")
def infer_types(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(*[F.col(c).cast("string").alias(c) for c in _INFER_COLS])
    return V.infer_string_types(p)


@register("props_parse", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
  round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS avg_k FROM events GROUP BY event_type""", "F9 S2")
def props_parse(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.withColumn("p", F.from_json("props", "k bigint"))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("sum_k"),
                                        round6(F.avg("p.k")).alias("avg_k"))


def suite() -> ExpectationSuite:
    s = ExpectationSuite()
    s.add("o_orderkey", "column_values_to_not_be_null")
    s.add("o_orderkey", "column_values_to_be_unique")
    s.add("o_totalprice", "column_values_to_be_between", min_value=1000, max_value=400000)
    s.add("o_totalprice", "column_mean_to_be_between", min_value=100000, max_value=300000)
    s.add("o_totalprice", "column_stdev_to_be_between", min_value=0, max_value=100000)
    s.add("o_totalprice", "column_median_to_be_between", min_value=0, max_value=250000)
    s.add("o_totalprice", "column_min_to_be_between", min_value=0, max_value=2000)
    s.add("o_totalprice", "column_max_to_be_between", min_value=0, max_value=500000)
    s.add("o_orderstatus", "column_values_to_be_in_set", value_set=["F", "O"])
    s.add("o_orderpriority", "column_values_to_match_regex", regex="^[1-5]-[A-Z]")
    s.add("o_custkey", "column_unique_value_count_to_be_between", min_value=1000, max_value=2000)
    s.add("o_orderstatus", "column_values_to_be_cool")          # unknown name: ignored
    s.add("o_comment", "column_values_to_not_be_null")          # absent column: skipped
    s.add("_dataframe_", "table_row_count_to_be_between", min_value=1, max_value=10**12)
    s.add("_dataframe_", "table_columns_to_match_set", column_set=[
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return s


def _exp_sql():
    rows = [
        ("o_orderkey", "column_values_to_not_be_null", "count(*) FILTER (WHERE o_orderkey IS NULL)", True, "u = 0"),
        ("o_orderkey", "column_values_to_be_unique", "count(o_orderkey) - count(DISTINCT o_orderkey)", True, "u = 0"),
        ("o_totalprice", "column_values_to_be_between",
         "count(*) FILTER (WHERE o_totalprice IS NOT NULL AND NOT (o_totalprice >= 1000 AND o_totalprice <= 400000))", True, "u = 0"),
        ("o_totalprice", "column_mean_to_be_between", "avg(o_totalprice)", False, "o >= 100000 AND o <= 300000"),
        ("o_totalprice", "column_stdev_to_be_between", "stddev_samp(o_totalprice)", False, "o >= 0 AND o <= 100000"),
        ("o_totalprice", "column_median_to_be_between", "quantile_cont(o_totalprice, 0.5)", False, "o >= 0 AND o <= 250000"),
        ("o_totalprice", "column_min_to_be_between", "min(o_totalprice)", False, "o >= 0 AND o <= 2000"),
        ("o_totalprice", "column_max_to_be_between", "max(o_totalprice)", False, "o >= 0 AND o <= 500000"),
        ("o_orderstatus", "column_values_to_be_in_set",
         "count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))", True, "u = 0"),
        ("o_orderpriority", "column_values_to_match_regex",
         "count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]'))", True, "u = 0"),
        ("o_custkey", "column_unique_value_count_to_be_between", "count(DISTINCT o_custkey)", False, "o >= 1000 AND o <= 2000"),
        ("_dataframe_", "table_row_count_to_be_between", "count(*)", False, "o >= 1 AND o <= 1000000000000"),
        ("_dataframe_", "table_columns_to_match_set", "max(6)", False, "true"),
    ]
    parts = []
    for col, name, agg, is_count, ok in rows:
        u = f"CAST({agg} AS DOUBLE)" if is_count else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{col}' AS column, '{name}' AS expectation, coalesce({ok}, false) AS success, "
                     f"round(o, 6) AS observed, u AS unexpected_count, CAST(NULL AS VARCHAR) AS error "
                     f"FROM (SELECT CAST({agg} AS DOUBLE) AS o, {u} AS u FROM orders)")
    return " UNION ALL ".join(parts)


@register("expectations", _exp_sql(), "A10 X3")
def expectations(spark, sf_dir):
    out = suite().validate(Tables(spark, sf_dir).orders)
    return out.withColumns({"observed": round6(F.col("observed")),
                            "unexpected_count": F.col("unexpected_count").cast("double")})


def more_expectations() -> ExpectationSuite:
    """Order, combinations, distributions and ``mostly``, each in a form that holds and one that does not."""
    s = ExpectationSuite()
    s.add("o_totalprice", "column_values_to_be_between", min_value=50000, max_value=400000, mostly=0.8)
    s.add("o_totalprice", "column_values_to_be_between", min_value=50000, max_value=400000, mostly=0.99)
    s.add("o_orderstatus", "column_values_to_not_be_in_set", value_set=["P"], mostly=0.5)
    s.add("o_orderstatus", "column_values_to_not_be_in_set", value_set=["P"])
    s.add("o_orderpriority", "column_value_lengths_to_be_between", min_value=5, max_value=8)
    s.add("o_orderkey", "column_values_to_be_increasing", order_by=["o_orderkey"], strictly=True)
    s.add("o_totalprice", "column_values_to_be_increasing", order_by=["o_orderkey"])
    s.add("o_totalprice", "column_values_to_be_decreasing", order_by=["o_orderkey"])
    s.add("o_custkey", "column_proportion_of_unique_values_to_be_between", min_value=0.0, max_value=0.5)
    s.add("o_orderstatus", "column_distinct_values_to_be_in_set", value_set=["F", "O"])
    s.add("o_orderstatus", "column_distinct_values_to_contain_set", value_set=["F", "P"])
    s.add("o_totalprice", "column_quantile_values_to_be_between", quantiles=[0.1, 0.9], value_ranges=[[0, 400000], [0, 1000]])
    s.add("o_totalprice", "column_kl_divergence_to_be_less_than", bins=[0, 100000, 200000, 600000], weights=[0.3, 0.3, 0.4], threshold=0.5)
    s.add("o_orderstatus", "column_kl_divergence_to_be_less_than", values=["F", "O", "P"], weights=[0.9, 0.05, 0.05], threshold=0.1)
    s.add("o_orderstatus", "column_kl_divergence_to_be_less_than", values=["F", "O"], weights=[0.5, 0.5], threshold=9.0)
    s.add("_dataframe_", "compound_columns_to_be_unique", column_list=["o_custkey", "o_orderdate"])
    s.add("_dataframe_", "compound_columns_to_be_unique", column_list=["o_custkey", "o_orderkey"])
    s.add("_dataframe_", "column_pair_values_a_to_be_greater_than_b", column_A="o_totalprice", column_B="o_custkey", mostly=0.9)
    s.add("_dataframe_", "table_column_count_to_equal", value=6)
    return s


def _more_sql():
    bad = lambda cond: f"(SELECT count(*) FILTER (WHERE NOT ({cond})) FROM orders)"
    breaks = lambda c, op: f"(SELECT count(*) FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE v {op} b)"
    again = lambda cols: f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY {cols}) WHERE n > 1)"
    kl = lambda cond, weights: "(SELECT " + " + ".join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) * ln(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) / {w})" for c, w in zip(cond, weights, strict=True)) + " FROM orders)"
    price = ["o_totalprice < 100000", "o_totalprice >= 100000 AND o_totalprice < 200000", "o_totalprice >= 200000"]
    status = [f"o_orderstatus = '{x}'" for x in "FOP"]
    n = "(SELECT count(*) FROM orders)"
    between, pair = bad("o_totalprice BETWEEN 50000 AND 400000"), bad("o_totalprice > o_custkey")
    rows = [
        ("o_totalprice", "column_values_to_be_between", between, True, f"{n} - o >= 0.8 * {n}"),
        ("o_totalprice", "column_values_to_be_between", between, True, f"{n} - o >= 0.99 * {n}"),
        ("o_orderstatus", "column_values_to_not_be_in_set", bad("o_orderstatus <> 'P'"), True, f"{n} - o >= 0.5 * {n}"),
        ("o_orderstatus", "column_values_to_not_be_in_set", bad("o_orderstatus <> 'P'"), True, "o = 0"),
        ("o_orderpriority", "column_value_lengths_to_be_between", bad("length(o_orderpriority) BETWEEN 5 AND 8"), True, "o = 0"),
        ("o_orderkey", "column_values_to_be_increasing", breaks("o_orderkey", "<="), True, "o = 0"),
        ("o_totalprice", "column_values_to_be_increasing", breaks("o_totalprice", "<"), True, "o = 0"),
        ("o_totalprice", "column_values_to_be_decreasing", breaks("o_totalprice", ">"), True, "o = 0"),
        ("o_custkey", "column_proportion_of_unique_values_to_be_between", "(SELECT count(DISTINCT o_custkey) / count(*) FROM orders)", False, "o <= 0.5"),
        ("o_orderstatus", "column_distinct_values_to_be_in_set", "(SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))", True, "o = 0"),
        ("o_orderstatus", "column_distinct_values_to_contain_set", "(SELECT 2 - count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus IN ('F', 'P'))", True, "o = 0"),
        ("o_totalprice", "column_quantile_values_to_be_between", "(SELECT 1)", True, "false"),
        ("o_totalprice", "column_kl_divergence_to_be_less_than", kl(price, [0.3, 0.3, 0.4]), False, "o < 0.5"),
        ("o_orderstatus", "column_kl_divergence_to_be_less_than", kl(status, [0.9, 0.05, 0.05]), False, "o < 0.1"),
        ("o_orderstatus", "column_kl_divergence_to_be_less_than", "NULL", False, "false"),
        ("_dataframe_", "compound_columns_to_be_unique", again("o_custkey, o_orderdate"), True, "o = 0"),
        ("_dataframe_", "compound_columns_to_be_unique", again("o_custkey, o_orderkey"), True, "o = 0"),
        ("_dataframe_", "column_pair_values_a_to_be_greater_than_b", pair, True, f"{n} - o >= 0.9 * {n}"),
        ("_dataframe_", "table_column_count_to_equal", "6", False, "true"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{col}' AS column, '{name}' AS expectation, coalesce({ok}, false) AS success, round(o, 6) AS observed, "
        f"{'o' if counted else 'CAST(NULL AS DOUBLE)'} AS unexpected_count, CAST(NULL AS VARCHAR) AS error FROM (SELECT CAST({value} AS DOUBLE) AS o)"
        for col, name, value, counted, ok in rows)


@register("expectations_more", _more_sql(), "A10 X3")
def expectations_more(spark, sf_dir):
    out = more_expectations().validate(Tables(spark, sf_dir).orders)
    return out.withColumns({"observed": round6(F.col("observed")),
                            "unexpected_count": F.col("unexpected_count").cast("double")})
