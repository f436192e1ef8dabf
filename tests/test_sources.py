import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.operators.preprocess import FeatureWidthError, check_width, fit_width
from sparkfeat.sources import readers as R
from sparkfeat.sources import sinks as K

# The reference's stored run record (metrics and parameters).
RUN = {"run_id": "run-a", "experiment_name": "survival_prediction",
       "metrics": {"accuracy": 0.7039106145251397, "precision": 0.5975609756097561,
                   "recall": 0.7101449275362319, "f1": 0.6490066225165563, "roc_auc": 0.792094861660079},
       "parameters": {"n_estimators": 200, "max_depth": 8, "min_samples_split": 5, "min_samples_leaf": 4,
                      "max_features": "sqrt", "random_state": 42, "class_weight": "balanced_subsample",
                      "n_jobs": -1}}


def test_multiline_run_records(spark, tmp_path):
    for i in range(2):
        rec = dict(RUN, run_id=f"run{i}")
        (tmp_path / f"run_info_{i}.json").write_text(json.dumps(rec, indent=4))
    runs = R.read_run_records(spark, str(tmp_path / "run_info_*.json"))
    rows = runs.select("run_id", "metrics.f1", "parameters.max_depth").orderBy("run_id").collect()
    assert [tuple(r) for r in rows] == [("run0", RUN["metrics"]["f1"], 8), ("run1", RUN["metrics"]["f1"], 8)]


def test_typed_csv_lowercases_and_keeps_corrupt_rows(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text("PassengerId,Survived,Age\n1,0,22.0\n2,1,abc\n3,0,\n")
    schema = T.StructType([T.StructField("PassengerId", T.LongType()), T.StructField("Survived", T.LongType()),
                           T.StructField("Age", T.DoubleType())])
    df = R.read_csv_typed(spark, str(p), schema, keep_corrupt=True)
    assert df.columns == ["passengerid", "survived", "age", "_corrupt_record"]
    rows = {r["passengerid"]: r for r in df.collect()}
    assert rows[1]["age"] == 22.0 and rows[3]["age"] is None
    assert rows[2]["age"] is None and rows[2]["_corrupt_record"] == "2,1,abc"


def test_request_log_and_sinks(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text(
        '{"trace_id": "t1", "ts": "2024-01-01T00:00:01Z", "model_version": "v1", "endpoint": "/predict", '
        '"latency_ms": 12.5, "status": "200", "level": "INFO"}\n')
    df = R.read_request_log(spark, str(log))
    assert df.first()["latency_ms"] == 12.5
    out = str(tmp_path / "preds")
    preds = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, date string")
    K.append_table(preds, out, ["date"])
    K.append_table(preds, out, ["date"])
    assert spark.read.parquet(out).count() == 4
    prof = spark.createDataFrame([("Age", 1.0)], "feature string, mean double")
    health = spark.createDataFrame([("store", "healthy")], "component string, status string")
    K.write_monitoring_report(prof, health, str(tmp_path / "report"))
    rep = spark.read.json(str(tmp_path / "report")).first()
    assert rep["feature_stats"][0]["feature"] == "Age" and rep["health_status"][0]["status"] == "healthy"


def test_width_check_and_fit(spark):
    check_width(["a"] * 9, 9)
    with pytest.raises(FeatureWidthError):
        check_width(["a"] * 8, 9)
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    r = df.select(fit_width(F.col("v"), 4).alias("p"), fit_width(F.col("v"), 1).alias("t")).first()
    assert r["p"] == [1.0, 2.0, 0.0, 0.0] and r["t"] == [1.0]
