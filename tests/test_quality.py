import math

from pyspark.sql import functions as F

from sparkfeat.operators import quality as Q
from sparkfeat.sources.tables import nan_to_null


def test_rule_pass_rate_null_counts_as_failure(spark):
    df = spark.createDataFrame([(1.0,), (None,), (200.0,), (30.0,)], "age double")
    out = {r["rule"]: r["pass_rate"] for r in Q.rule_pass_rates(df, {
        "age not null": F.col("age").isNotNull(),
        "age between 0 and 120": F.col("age").between(0, 120)}).collect()}
    assert out["age not null"] == 0.75
    assert out["age between 0 and 120"] == 0.5          # NULL and 200 fail, mean over all rows
    assert math.isclose(out["overall"], 0.625)


def test_numeric_quality_nan_is_missing_after_normalisation(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    r = Q.numeric_quality(nan_to_null(df), ["x"]).first()
    assert r["mean"] == 2.0 and r["missing_rate"] == 0.5
    assert r["valid"] is False and r["reasons"] == "High missing rate: 0.50"


def test_numeric_quality_constant_and_single_row(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    r = Q.numeric_quality(df, ["x"]).first()
    assert r["std"] is None and r["valid"] is True and r["reasons"] == ""


def test_categorical_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", None]], "c string")
    r = Q.categorical_quality(df, ["c"]).first()
    assert r["unique_values"] == 3
    assert r["top_values"] == "a:2, b:2, c:1"
    assert math.isclose(r["missing_rate"], 1 / 6)


def test_categorical_too_many_values(spark):
    df = spark.range(150).select(F.col("id").cast("string").alias("c"))
    r = Q.categorical_quality(df, ["c"]).first()
    assert r["valid"] is False and r["reasons"] == "Too many unique values: 150"
    assert len(r["top_values"].split(", ")) == 5


def test_empty_frame_profiles(spark):
    df = spark.createDataFrame([], "x double, c string")
    assert Q.numeric_profile(df, ["x"]).first()["mean"] is None
    assert Q.categorical_profile(df, ["c"]).count() == 0


def test_boolean_and_text_quality(spark):
    df = spark.createDataFrame([(True, "ab"), (False, "abcd"), (True, None), (None, "x")],
                               "b boolean, t string")
    shares = {r["value"]: r["share"] for r in Q.boolean_quality(df, ["b"]).collect()}
    assert math.isclose(shares["true"], 2 / 3) and math.isclose(shares["false"], 1 / 3)
    t = Q.text_quality(df, ["t"]).first()
    assert t["avg_length"] == 7 / 3 and t["max_length"] == 4 and t["missing_rate"] == 0.25


def test_passenger_rules_on_three_row_frame(spark):
    df = spark.createDataFrame([(1, "male", 22.0, 7.25), (2, "female", 35.0, 71.2833), (3, "male", None, 8.05)],
                               "Pclass long, Sex string, Age double, Fare double")
    out = {r["rule"]: r["pass_rate"] for r in Q.rule_pass_rates(df, Q.PASSENGER_RULES).collect()}
    assert out["Age not null"] == 2 / 3 and out["Age between 0 and 120"] == 2 / 3
    assert out["Sex in [male, female]"] == 1.0 and out["Fare >= 0"] == 1.0 and out["Pclass in [1, 2, 3]"] == 1.0
    assert math.isclose(out["overall"], (2 / 3 * 2 + 3) / 5)


def test_empty_frame_rules_do_not_fail_validity(spark):
    df = spark.createDataFrame([], "x double, t timestamp, s string")
    assert Q.numeric_quality(df, ["x"]).first()["valid"] is True
    assert Q.timestamp_quality(df, ["t"]).first()["valid"] is True
    assert Q.text_quality(df, ["s"]).first()["valid"] is True
