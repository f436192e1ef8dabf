"""What the operators share: reading documents, Arrow batches, shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.session import scratch_path
from sparkfeat.sources.tables import read_table

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of a public tokenizer file; the package is installed on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under its own names, so that further columns of the
    input can have any name. A null text becomes the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that tasks can import it
    wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp()) / "sparkfeat-package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "sparkfeat").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, records: int = 2000, mb: int = 16) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


#: What a task calls at its end to drop tables that grew with the texts it saw.
AT_END: list[Callable[[], None]] = []


def release_memory() -> None:
    """Drops grown tables and gives freed memory back to the system: an idle worker waits for its next
    task, of this stage or a later one, beside others."""
    for drop in AT_END:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):                # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; dicts of columns become batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = make(b)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        release_memory()
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(name).to_pylist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back: cuts lineage, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_parts(df: DataFrame, col: str, parts: int):
    """(function from the column to its range's number, number of ranges): ranges of about equal
    rows between quantiles of a long column; the cut points, one per range, go to the tasks."""
    quantiles = df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(quantiles, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def part_of(place):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))
    return part_of, len(bounds) + 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


M64 = (1 << 64) - 1


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
