"""A feature table whose partitions are replaced one by one (S3), batch or stream.

Each upsert reads, merges and writes only the ``feature_name`` partitions that its rows touch, into a folder
of its own, and then publishes one small file that names the current folder of every feature. Readers take
the newest published file, so they see all of an upsert or nothing of it, and folders that an upsert does not touch
stay as they are. An upsert has a number; publishing it twice does nothing, so a replayed stream batch is
harmless, and a folder that was written but not published is written anew.

One writer at a time. Old folders stay for readers that began earlier; ``vacuum`` drops those that the
newest file no longer names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.operators.store import FEATURE_KEY, upsert
from sparkfeat.sources.files import delete, exists, list_names

ROWS = "entity_id string, feature_name string, feature_version string, value string, ts timestamp"
PUBLISHED = "feature_name string, path string, number long"


def _newest(spark: SparkSession, root: str) -> int | None:
    done = [int(n.removeprefix("number=")) for n in list_names(spark, f"{root}/published")
            if n.startswith("number=") and exists(spark, f"{root}/published/{n}/_SUCCESS")]
    return max(done, default=None)


def current_partitions(spark: SparkSession, root: str) -> list:
    """One row per feature: feature_name, path, number of the upsert that wrote it."""
    newest = _newest(spark, root)
    return [] if newest is None else spark.read.schema(PUBLISHED).json(f"{root}/published/number={newest}").collect()


def read_features(spark: SparkSession, root: str, features: list[str] | None = None) -> DataFrame:
    """The table, or the partitions of some features, as the newest upsert left it."""
    paths = [r["path"] for r in current_partitions(spark, root) if features is None or r["feature_name"] in features]
    return spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)


def upsert_features(spark: SparkSession, root: str, updates: DataFrame, number: int, tiebreak: str | None = None) -> list[str]:
    """Merges ``updates`` (entity_id, feature_name, feature_version, value, ts) into the table as upsert ``number``, which must
    grow from upsert to upsert. Returns the touched features; those of a number published before are none."""
    newest = _newest(spark, root)
    if newest is not None and number <= newest:
        return []
    extra = [tiebreak] if tiebreak else []
    updates = updates.select(*FEATURE_KEY, "value", F.col("ts").cast("timestamp").alias("ts"), *extra).where("feature_name is not null").persist()
    try:
        touched = sorted(r[0] for r in updates.select("feature_name").distinct().collect())   # names of features, not rows
        before = current_partitions(spark, root)
        empty = updates.limit(0)
        merged = upsert(read_features(spark, root, touched), upsert(empty, updates, tiebreak)) if before else upsert(empty, updates, tiebreak)
        data = f"{root}/data/number={number}"
        # the partition column is a copy: a file holds all columns, wherever it lies
        merged.select("*", F.col("feature_name").alias("of")).write.mode("overwrite").partitionBy("of").parquet(data)
    finally:
        updates.unpersist()
    own = {n.removeprefix("of="): f"{data}/{n}" for n in list_names(spark, data) if n.startswith("of=")}
    from urllib.parse import unquote
    own = {unquote(k): v for k, v in own.items()}
    rows = [(r["feature_name"], r["path"], r["number"]) for r in before if r["feature_name"] not in own]
    rows += [(name, path, number) for name, path in own.items()]
    spark.createDataFrame(rows, PUBLISHED).coalesce(1).write.mode("overwrite").json(f"{root}/published/number={number}")
    return touched


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, tiebreak: str | None = None) -> None:
    """Drains a stream of feature rows into the table, one upsert a batch."""
    spark = stream.sparkSession
    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, n: upsert_features(spark, root, batch, n, tiebreak) and None)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes folders that the newest published file does not name; returns how many."""
    kept = {(r["number"], r["path"].rsplit("/", 1)[1]) for r in current_partitions(spark, root)}
    gone = 0
    for n in list_names(spark, f"{root}/data"):
        for part in list_names(spark, f"{root}/data/{n}"):
            if part.startswith("of=") and (int(n.removeprefix("number=")), part) not in kept:
                delete(spark, f"{root}/data/{n}/{part}")
                gone += 1
    return gone
