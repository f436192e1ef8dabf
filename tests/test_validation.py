from pyspark.sql import functions as F

from sparkfeat.operators import validation as V
from sparkfeat.operators.expectations import ExpectationSuite


def test_report_null_is_non_numeric_and_row_counts(spark):
    df = spark.createDataFrame([(1.0, "S"), (None, "C"), (150.0, "X"), (30.0, None)], "Age double, Embarked string")
    defs = {"Age": V.FeatureDefinition("numeric", min_value=0, max_value=120),
            "Embarked": V.FeatureDefinition("categorical", allowed_values=["C", "Q", "S"]),
            "Fare": V.FeatureDefinition("numeric")}
    per, summary = V.validate_dataset(df, defs)
    rows = {r["feature"]: r for r in per.collect()}
    assert rows["Age"]["errors"] == "Contains non-numeric values; Values above maximum (120)"
    assert rows["Embarked"]["errors"] == "Contains invalid values: X"      # the values themselves, as many as are listed
    assert rows["Embarked"]["value_counts"] == "C=1, S=1, X=1" and rows["Embarked"]["invalid_values"] == "X"
    assert rows["Embarked"]["unique_values"] == 3 and rows["Embarked"]["invalid_value_count"] == 1
    short, _ = V.validate_dataset(df.union(spark.createDataFrame([(1.0, "Y"), (1.0, "Y")], df.schema)), defs, listed=1)
    odd = {r["feature"]: r for r in short.collect()}["Embarked"]
    assert odd["errors"] == "Contains invalid values: X and 1 more" and odd["value_counts"] == "Y=2"
    s = summary.first()
    assert s["missing_columns"] == "Fare" and s["invalid_features"] == 3
    assert s["invalid_rows"] == 2 and s["valid_rows"] == 2     # row 2 (NULL age) and row 3
    lax, _ = V.validate_dataset(df, defs, strict_nulls=False)
    assert {r["feature"]: r["errors"] for r in lax.collect()}["Age"] == "Values above maximum (120)"
    inv = V.invalid_values(df, defs).collect()
    assert [(r["feature"], r["value"], r["n"]) for r in inv] == [("Embarked", "X", 1)]


def test_request_split_reasons(spark):
    df = spark.createDataFrame([(1, "male", 22.0), (5, "unknown", -1.0), (2, None, None)],
                               "Pclass int, Sex string, Age double")
    rules = [V.RowRule("Pclass must be 1, 2 or 3", F.col("Pclass").isin(1, 2, 3)),
             V.RowRule("Sex must be male or female", F.col("Sex").isin("male", "female")),
             V.RowRule("Age must be between 0 and 120", F.col("Age").between(0, 120))]
    ok, bad = V.split_requests(df, rules)
    assert ok.count() == 1
    got = {r["Pclass"]: r["reasons"] for r in bad.collect()}
    assert got[5] == ["Pclass must be 1, 2 or 3", "Sex must be male or female", "Age must be between 0 and 120"]
    assert got[2] == ["Sex must be male or female", "Age must be between 0 and 120"]


def test_value_checks_and_type_inference(spark):
    decl = {"Age": V.ValueDeclaration("numeric", 0, 120), "Sex": V.ValueDeclaration("categorical", categories=["male"])}
    df = spark.createDataFrame([("Age", "30"), ("Age", "abc"), ("Age", None), ("Sex", "male"), ("Other", "x")],
                               "f string, v string")
    assert [r[0] for r in df.select(V.value_is_valid(F.col("f"), F.col("v"), decl)).collect()] == \
        [True, False, False, True, True]
    t = spark.createDataFrame([("1", "a"), ("2.5", "3"), (None, None)], "x string, y string")
    types = {r["column"]: r["inferred_type"] for r in V.infer_string_types(t).collect()}
    assert types == {"x": "numeric", "y": "string"}


def test_expectations_unknown_ignored_absent_skipped_json(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "k int, s string")
    suite = (ExpectationSuite().add("k", "column_values_to_be_unique")
             .add("k", "column_values_to_be_between", min_value=1, max_value=1)
             .add("s", "column_values_to_not_be_null").add("s", "column_values_to_match_regex", regex="^[ab]$")
             .add("k", "no_such_expectation").add("missing", "column_values_to_not_be_null")
             .add("_dataframe_", "table_row_count_to_be_between", min_value=1, max_value=3))
    again = ExpectationSuite.from_json(suite.to_json())
    res = {(r["column"], r["expectation"]): r for r in again.validate(df).collect()}
    assert len(res) == 5
    assert res[("k", "column_values_to_be_unique")]["success"] is False
    assert res[("k", "column_values_to_be_between")]["unexpected_count"] == 2
    assert res[("s", "column_values_to_not_be_null")]["unexpected_count"] == 1
    assert res[("s", "column_values_to_match_regex")]["success"] is True
    assert res[("_dataframe_", "table_row_count_to_be_between")]["success"] is True


def test_expectation_median(spark):
    df = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS x")
    s = ExpectationSuite().add("x", "column_median_to_be_between", min_value=49, max_value=51)
    r = s.validate(df).first()
    assert r["observed"] == 50.0 and r["success"] is True


def test_one_bad_expectation_fails_alone(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "s string, x double")
    suite = (ExpectationSuite().add("s", "column_mean_to_be_between", min_value=0)
             .add("s", "column_values_to_match_regex", regex="(")
             .add("x", "column_mean_to_be_between", min_value=1, max_value=1))
    rows = {(r["column"], r["expectation"]): r for r in suite.validate(df).collect()}
    assert rows[("s", "column_mean_to_be_between")]["success"] is False
    assert rows[("s", "column_values_to_match_regex")]["error"] is not None
    assert rows[("x", "column_mean_to_be_between")]["success"] is True


def test_value_declarations(spark):
    D = V.ValueDeclaration
    decls = {"c": D("categorical"), "i": D("integer", min_value=1), "s": D("string", categories=["x"]), "t": D("categorical", max_value=3),
             "n": D("numeric", categories=[1, 2])}
    rows = [("c", "any", True), ("c", None, False), ("i", "2", True), ("i", "2.5", False), ("i", "0", False), ("s", "x", True), ("s", "y", False),
            ("t", "3", True), ("t", "4", False), ("t", "z", False), ("n", "1", True), ("n", "3", False), ("other", None, True)]
    df = spark.createDataFrame(rows, "f string, v string, want boolean")
    got = df.select("want", V.value_is_valid(F.col("f"), F.col("v"), decls).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_request_contract_rejects_invalid_request(spark):
    schema = "Pclass string, Sex string, Age double, SibSp long, Parch long, Fare double, Embarked string"
    df = spark.createDataFrame([("1", "female", 29.0, 0, 0, 100.0, "S"),
                                ("3", "male", None, 1, 2, 8.05, "Q"),
                                ("invalid", "unknown", -1.0, None, None, None, None)], schema)
    ok, bad = V.split_requests(df, V.contract_rules())
    assert ok.count() == 1
    reasons = {r["Pclass"]: r["reasons"] for r in bad.collect()}
    assert reasons["3"] == ["Age: field required"]
    assert "Pclass: must match ^[123]$" in reasons["invalid"]
    assert "Sex: must match ^(male|female)$" in reasons["invalid"]
    assert "Age: must be a number between 0 and 120" in reasons["invalid"]
    assert "Embarked: field required" in reasons["invalid"]


def test_apply_inferred_types(spark):
    t = spark.createDataFrame([("1", "a"), ("2.5", "3")], "x string, y string")
    types = {r["column"]: r["inferred_type"] for r in V.infer_string_types(t).collect()}
    out = V.apply_inferred_types(t, types)
    assert dict(out.dtypes) == {"x": "double", "y": "string"}
    assert [r.x for r in out.collect()] == [1.0, 2.5]
