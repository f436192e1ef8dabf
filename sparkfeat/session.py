"""Session creation and shared settings.

Cluster deployments bring their own SparkSession; ``get_spark`` only fills in what
is missing so that local tests and the bench behave like the cluster (UTC, AQE).
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so timestamps agree with parquet/DuckDB,
# AQE for runtime coalescing and skew-join splitting, Arrow for pandas stages.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sparkfeat", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is respected as is.
    Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        configured = tempfile.mkdtemp(prefix="sparkfeat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sparkfeat-{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that tasks with Python code of
    it can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / "sparkfeat-package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "sparkfeat").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def sizing_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                min_partitions: int = 200) -> dict:
    """Partition sizing for a job over ``input_bytes`` of input.

    Scan splits and shuffle partitions aim at ``target_partition_bytes`` so a task's data
    fits executor memory without spilling; AQE then coalesces small shuffle partitions and
    splits skewed ones (a key holding a third of the rows is split, not run as one task).
    """
    n = max(min_partitions, -(-input_bytes // target_partition_bytes))
    mb = f"{target_partition_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": mb,
    }


def apply_sizing(spark: SparkSession, input_bytes: int, **kw) -> None:
    """Set the runtime-changeable sizing options on an existing session."""
    for k, v in sizing_conf(input_bytes, **kw).items():
        spark.conf.set(k, v)
