"""Reading the parquet tables and normalising the pandas-vs-Spark traps once.

* pandas treats NaN as missing; Spark aggregates do not skip NaN → ``nan_to_null``.
* test parquet timestamps are ``timestamp_ntz``; streaming watermarks need
  ``timestamp`` → ``ntz_to_ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in floating columns (all of them when ``cols`` is None)."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or floating) if c in floating]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def ntz_to_ts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cast ``timestamp_ntz`` columns to session-zone ``timestamp`` (needed by watermarks)."""
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    targets = [c for c in (cols or ntz) if c in ntz]
    if not targets:
        return df
    return df.withColumns({c: F.col(c).cast("timestamp") for c in targets})
