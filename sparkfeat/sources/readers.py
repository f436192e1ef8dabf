"""Readers for the reference's inputs: typed CSV (S1), request/prediction logs (S7) and
training-run records (S8). All are declared-schema reads — no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request/prediction log record (structured logging fields).
REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("level", T.StringType()),
])

# Training-run record: nested metrics and parameters.
RUN_RECORD_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("experiment_name", T.StringType()),
    T.StructField("metrics", T.StructType([T.StructField(n, T.DoubleType()) for n in
                                           ("accuracy", "precision", "recall", "f1", "roc_auc")])),
    T.StructField("parameters", T.StructType([
        T.StructField("n_estimators", T.LongType()), T.StructField("max_depth", T.LongType()),
        T.StructField("min_samples_split", T.LongType()), T.StructField("min_samples_leaf", T.LongType()),
        T.StructField("max_features", T.StringType()), T.StructField("random_state", T.LongType()),
        T.StructField("class_weight", T.StringType()), T.StructField("n_jobs", T.LongType())])),
])


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, lower_names: bool = True,
                   keep_corrupt: bool = False) -> DataFrame:
    """Header CSV with a declared schema; malformed rows are kept (PERMISSIVE) with the
    raw line in ``_corrupt_record`` when ``keep_corrupt``."""
    sch = schema
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if keep_corrupt:
        sch = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    df = reader.schema(sch).csv(path)
    return standardize_column_names(df) if lower_names else df


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines request log with the declared schema."""
    return spark.read.schema(REQUEST_LOG_SCHEMA).json(path)


CORRUPT = "_corrupt_record"


def stream_request_log(spark: SparkSession, path: str, watermark: str = "10 minutes",
                       max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S7 as a stream: (records, broken lines). Records are those of the declared schema, each ``trace_id`` once
    while the watermark remembers it (a record that is sent again is dropped; one without an id is kept). A line that is no
    JSON of the schema, or has no time, goes to the second stream as its text."""
    schema = T.StructType([*REQUEST_LOG_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.json(path)
    broken = F.col(CORRUPT).isNotNull() | F.col("ts").isNull()
    fields = [f.name for f in REQUEST_LOG_SCHEMA.fields]
    # a record without an id is its own: its key is a hash of all it says and a random number
    once = F.coalesce(F.col("trace_id"), F.concat(F.lit("no id "), F.uuid()))
    records = (lines.where(~broken).select(*fields, once.alias("_once")).withWatermark("ts", watermark)
               .dropDuplicatesWithinWatermark(["_once"]).drop("_once"))
    rest = lines.where(broken).select(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*fields))).alias("line"))
    return records, rest


def read_run_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run records (one JSON document per file when ``multi_line``)."""
    return spark.read.option("multiLine", multi_line).schema(RUN_RECORD_SCHEMA).json(path)
