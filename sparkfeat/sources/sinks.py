"""Sinks: monitoring report (S5), append-only result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_monitoring_report(profile: DataFrame, health: DataFrame, path: str) -> None:
    """One JSON record holding the feature statistics, the health status and the time.

    The profile and health inputs are small per-feature / per-component aggregates; they are
    nested into a single row by an aggregate, never collected to the driver.
    """
    f = F.struct(*profile.columns)
    h = F.struct(*health.columns)
    ftype, htype = profile.select(f.alias("x")).schema["x"].dataType, health.select(h.alias("x")).schema["x"].dataType
    both = (profile.select(f.alias("f"), F.lit(None).cast(htype).alias("h"))
            .unionByName(health.select(F.lit(None).cast(ftype).alias("f"), h.alias("h"))))
    report = both.agg(F.collect_list("f").alias("feature_stats"),          # NULLs are skipped
                      F.collect_list("h").alias("health_status")).withColumn(
        "timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    report.coalesce(1).write.mode("overwrite").json(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append results (predictions, metrics, drift) partitioned by date."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
