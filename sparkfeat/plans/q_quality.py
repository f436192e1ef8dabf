"""Catalogue: data-quality rules, validators and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import round6
from sparkfeat.operators import quality as Q
from sparkfeat.plans.registry import Tables, register


def _round(df, cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


# The five request-style rules of the reference, re-aimed at lineitem columns.
LINEITEM_RULES_SQL = {
    "discount not null": "d IS NOT NULL",
    "discount between 0.02 and 0.08": "d BETWEEN 0.02 AND 0.08",
    "returnflag in [A, R]": "l_returnflag IN ('A', 'R')",
    "quantity >= 10": "l_quantity >= 10",
    "linenumber in [1, 2, 3]": "l_linenumber IN (1, 2, 3)",
}


def _rules_sql() -> str:
    names = list(LINEITEM_RULES_SQL)
    aggs = ",\n  ".join(
        f"avg(CASE WHEN {LINEITEM_RULES_SQL[n]} THEN 1.0 ELSE 0.0 END)::DOUBLE AS r{i}"
        for i, n in enumerate(names))
    parts = [f"SELECT '{n}' AS rule, round(r{i}, 6) AS pass_rate FROM r"
             for i, n in enumerate(names)]
    total = " + ".join(f"r{i}" for i in range(len(names)))
    parts.append(f"SELECT 'overall' AS rule, round(({total}) / {len(names)}.0, 6) AS pass_rate FROM r")
    return (f"WITH t AS (SELECT nullif(l_discount, 0.0) AS d, l_returnflag, l_quantity, "
            f"l_linenumber FROM lineitem),\nr AS (SELECT\n  {aggs}\nFROM t)\n"
            + "\nUNION ALL\n".join(parts))


@register("quality_rules", _rules_sql(), "A9")
def quality_rules(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.withColumn("d", F.expr("nullif(l_discount, 0.0)"))
    out = Q.rule_pass_rates(li, {n: F.expr(e) for n, e in LINEITEM_RULES_SQL.items()})
    return _round(out, ["pass_rate"])


_NUMERIC_FRAME_SQL = """SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS discount,
  nullif(l_tax, 0.0) AS tax, CASE WHEN l_quantity > 12 THEN l_quantity END AS qty_over_12
FROM lineitem"""
_NUMERIC_COLS = ["l_quantity", "l_extendedprice", "discount", "tax", "qty_over_12"]


def _numeric_sql() -> str:
    aggs = []
    rows = []
    for i, c in enumerate(_NUMERIC_COLS):
        aggs.append(f"avg({c}) AS mean{i}, stddev_samp({c}) AS std{i}, min({c}) AS min{i}, "
                    f"max({c}) AS max{i}, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS miss{i}")
        rows.append(
            f"SELECT '{c}' AS feature, round(mean{i}, 6) AS mean, round(std{i}, 6) AS std, "
            f"round(min{i}, 6) AS min, round(max{i}, 6) AS max, round(miss{i}, 6) AS missing_rate, "
            f"NOT (miss{i} > 0.2 OR coalesce(abs(mean{i}) > 1e10, false)) AS valid, "
            f"concat_ws('; ', CASE WHEN miss{i} > 0.2 THEN printf('High missing rate: %.2f', round(miss{i}, 2)) END, "
            f"CASE WHEN abs(mean{i}) > 1e10 THEN 'Extreme mean value: ' || CAST(mean{i} AS VARCHAR) END) AS reasons FROM a")
    return (f"WITH t AS ({_NUMERIC_FRAME_SQL}),\na AS (SELECT {', '.join(aggs)} FROM t)\n"
            + "\nUNION ALL\n".join(rows))


@register("quality_numeric", _numeric_sql(), "A4")
def quality_numeric(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_quantity", "l_extendedprice", "nullif(l_discount, 0.0) AS discount",
        "nullif(l_tax, 0.0) AS tax", "CASE WHEN l_quantity > 12 THEN l_quantity END AS qty_over_12")
    return _round(Q.numeric_quality(t, _NUMERIC_COLS),
                  ["mean", "std", "min", "max", "missing_rate"])


_CAT_COLS = ["o_orderstatus", "o_orderpriority", "priority_nu", "status_np", "cust"]
_CAT_FRAME = ["o_orderstatus", "o_orderpriority",
              "nullif(o_orderpriority, '1-URGENT') AS priority_nu",
              "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status_np",
              "CAST(o_custkey AS STRING) AS cust"]


def _categorical_sql() -> str:
    frame = ", ".join(_CAT_FRAME).replace("AS STRING", "AS VARCHAR")
    unions = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM t" for c in _CAT_COLS)
    return f"""WITH t AS (SELECT {frame} FROM orders),
u AS ({unions}),
c AS (SELECT feature, value, count(*) AS n FROM u GROUP BY feature, value),
s AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS total,
        CAST(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS DOUBLE) AS missing,
        count(value) AS unique_values FROM c GROUP BY feature),
r AS (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS rk
      FROM c WHERE value IS NOT NULL),
tv AS (SELECT feature, string_agg(value || ':' || CAST(n AS VARCHAR), ', ' ORDER BY rk) AS top_values
       FROM r WHERE rk <= 5 GROUP BY feature)
SELECT s.feature, s.unique_values, coalesce(tv.top_values, '') AS top_values,
  round(missing / total, 6) AS missing_rate,
  NOT (missing / total > 0.2 OR unique_values > 100) AS valid,
  concat_ws('; ', CASE WHEN missing / total > 0.2 THEN printf('High missing rate: %.2f', round(missing / total, 2)) END,
    CASE WHEN unique_values > 100 THEN printf('Too many unique values: %d', unique_values) END) AS reasons
FROM s LEFT JOIN tv ON s.feature = tv.feature"""


@register("quality_categorical", _categorical_sql(), "A5 O4")
def quality_categorical(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.selectExpr(*_CAT_FRAME)
    return _round(Q.categorical_quality(t, _CAT_COLS), ["missing_rate"])


@register("quality_timestamp", """WITH t AS (SELECT o_orderdate,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS open_date FROM orders)
SELECT 'o_orderdate' AS feature, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date,
  round(avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS missing_rate,
  avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 AS valid,
  coalesce(CASE WHEN avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE > 0.2 THEN printf('High missing rate: %.2f', round(avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 2)) END, '') AS reasons
FROM t
UNION ALL
SELECT 'open_date', strftime(min(open_date), '%Y-%m-%d %H:%M:%S'), strftime(max(open_date), '%Y-%m-%d %H:%M:%S'),
  round(avg(CASE WHEN open_date IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6),
  avg(CASE WHEN open_date IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2,
  coalesce(CASE WHEN avg(CASE WHEN open_date IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE > 0.2 THEN printf('High missing rate: %.2f', round(avg(CASE WHEN open_date IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 2)) END, '')
FROM t""", "A6")
def quality_timestamp(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.selectExpr(
        "o_orderdate", "CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS open_date")
    return _round(Q.timestamp_quality(t, ["o_orderdate", "open_date"]), ["missing_rate"])


@register("quality_boolean", """WITH t AS (SELECT quality = 1 AS is_quality,
  CASE WHEN toxic = 0 THEN quality = 1 END AS clean_quality FROM labels),
u AS (SELECT 'is_quality' AS feature, CAST(is_quality AS VARCHAR) AS value FROM t
      UNION ALL SELECT 'clean_quality', CAST(clean_quality AS VARCHAR) FROM t),
c AS (SELECT feature, value, count(*) AS n FROM u GROUP BY feature, value),
s AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS total,
        CAST(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS DOUBLE) AS missing FROM c GROUP BY feature)
SELECT c.feature, c.value, round(n / (total - missing), 6) AS share, round(missing / total, 6) AS missing_rate,
  missing / total <= 0.2 AS valid
FROM c JOIN s ON c.feature = s.feature WHERE c.value IS NOT NULL""", "A6")
def quality_boolean(spark, sf_dir):
    t = Tables(spark, sf_dir).labels.selectExpr(
        "quality = 1 AS is_quality", "CASE WHEN toxic = 0 THEN quality = 1 END AS clean_quality")
    return _round(Q.boolean_quality(t, ["is_quality", "clean_quality"]),
                  ["share", "missing_rate"])


@register("quality_text", """WITH t AS (SELECT text, lang, nullif(source, 'src0') AS src FROM documents)
SELECT f.feature, round(f.avg_length, 6) AS avg_length, f.max_length, round(f.missing_rate, 6) AS missing_rate,
  f.missing_rate <= 0.2 AS valid,
  coalesce(CASE WHEN f.missing_rate > 0.2 THEN printf('High missing rate: %.2f', round(f.missing_rate, 2)) END, '') AS reasons
FROM (
  SELECT 'text' AS feature, avg(length(text)) AS avg_length, CAST(max(length(text)) AS BIGINT) AS max_length,
    avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_rate FROM t
  UNION ALL SELECT 'lang', avg(length(lang)), CAST(max(length(lang)) AS BIGINT),
    avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE FROM t
  UNION ALL SELECT 'src', avg(length(src)), CAST(max(length(src)) AS BIGINT),
    avg(CASE WHEN src IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE FROM t) f""", "A6")
def quality_text(spark, sf_dir):
    t = Tables(spark, sf_dir).documents.selectExpr("text", "lang", "nullif(source, 'src0') AS src")
    return _round(Q.text_quality(t, ["text", "lang", "src"]), ["avg_length", "missing_rate"])


_PROFILE_NUM = ["c_acctbal", "c_custkey", "c_nationkey"]


@register("profile_numeric", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, "
    f"round(avg({c})::DOUBLE, 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, "
    f"round(stddev_samp({c}::DOUBLE), 6) AS std FROM customer" for c in _PROFILE_NUM), "A8")
def profile_numeric(spark, sf_dir):
    # medians ranked with the distributed plan (the one "auto" picks past the buffer size
    # check), so that plan runs on real data under the oracle
    out = Q.numeric_profile(Tables(spark, sf_dir).customer, _PROFILE_NUM)
    return _round(out, ["min", "max", "mean", "median", "std"])


@register("profile_categorical", """WITH u AS (SELECT 'c_mktsegment' AS feature, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
c AS (SELECT feature, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY feature, value)
SELECT feature, value AS category, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM c""", "A8")
def profile_categorical(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return _round(Q.categorical_profile(c, ["c_mktsegment", "c_nationkey"]), ["share"])
