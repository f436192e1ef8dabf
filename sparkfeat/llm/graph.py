"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import stored


#: Parts that the neighbours of one node are dealt over: a hub's edges are no single task.
SALTS = 16


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (a, b) with the ``m`` of their a: each part of a node's edges meets a copy of its one row."""
    parts = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return parts.join(copies, ["a", "salt"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    # a node's other lower neighbours go to its lowest one; so does the node itself
    moved = _with_least(down, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) of any orderable type → (node, root), where root is the component's least
    node; least nodes themselves are not listed. Every round's edges are written to the shared
    folder; a round is one join and one aggregate a step; hubs are combined map-side and joined in parts."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = stored(_small_star(_large_star(now).distinct()).distinct(), name)
