"""A/B assignment and results.

Assignment is a sticky hash of the unit id (``hash_unit``: md5 → [0, 1)), so a unit keeps
its arm across requests and the split is auditable in SQL. Re-weighting starts a new
epoch: the epoch name salts the hash so the new weights apply to fresh draws. The history of
epochs is a table; ``assign_by_epoch`` joins events with the epoch of their time.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.columns import hash_unit, is_close, safe_ratio
from sparkfeat.operators.asof import as_of

WEIGHT_TOLERANCE = 1e-8


def validate_weights(weights: Mapping[str, float]) -> None:
    total = sum(weights.values())
    if not math.isclose(total, 1.0, rel_tol=1e-5, abs_tol=WEIGHT_TOLERANCE):
        raise ValueError(f"Model weights must sum to 1.0, got {total}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative")


def two_arm(key: Column, control_share: float = 0.5, control: str = "control",
            treatment: str = "treatment", salt: str | None = None) -> Column:
    """control when the unit's bucket < share, else treatment."""
    return F.when(hash_unit(key, salt) < F.lit(control_share), F.lit(control)).otherwise(
        F.lit(treatment))


def weighted_arm(key: Column, weights: Mapping[str, float], epoch: str | None = None) -> Column:
    """half-open cumulative intervals in the given order; the last arm is open-ended."""
    validate_weights(weights)
    u = hash_unit(key, epoch)
    names = list(weights)
    expr = F.lit(names[-1])
    edges = []
    acc = 0.0
    for n in names[:-1]:
        acc += weights[n]
        edges.append((acc, n))
    for edge, n in reversed(edges):
        expr = F.when(u < F.lit(edge), F.lit(n)).otherwise(expr)
    return expr


def weight_history(spark, epochs: list[tuple[str, str, Mapping[str, float]]]) -> DataFrame:
    """(name, time from which it holds, weights) of each epoch as a table: epoch, valid_from, edges (of the arms'
    half-open intervals, the last one open-ended). Weights are validated."""
    rows = []
    for name, valid_from, weights in epochs:
        validate_weights(weights)
        acc, edges = 0.0, []
        for arm, w in weights.items():
            acc += w
            edges.append((acc, arm))
        rows.append((name, valid_from, [*edges[:-1], (float("inf"), edges[-1][1])]))
    table = spark.createDataFrame(rows, "epoch string, valid_from string, edges array<struct<edge:double,arm:string>>")
    return table.withColumn("valid_from", F.to_timestamp("valid_from"))


def assign_by_epoch(events: DataFrame, key: str, ts: str, history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``events`` with the epoch that held at their time and the arm that its weights give their unit: the arm
    of ``weighted_arm`` under that epoch. Before the first epoch both are NULL."""
    held = as_of(events, ts, history, "valid_from", ["epoch", "edges"], by)
    u = hash_unit(F.concat(F.col("epoch"), F.lit(":"), F.col(key).cast("string")))
    arm = F.get(F.filter("edges", lambda e: u < e["edge"]), F.lit(0))["arm"]
    return held.withColumn("arm", arm).drop("edges")


def epoch_results(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """Per epoch and arm: predictions, labelled ones, correct ones, accuracy (0 without labels). A prediction belongs to the
    epoch it was made in, whenever its label comes."""
    right = is_close(F.col(prediction).cast("double"), F.col(truth).cast("double"))
    out = df.where(F.col("epoch").isNotNull()).groupBy("epoch", "arm").agg(
        F.count(F.lit(1)).alias("predictions"), F.count(truth).alias("labelled"), F.count_if(right).alias("correct"))
    return out.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("labelled")))


def ab_results(df: DataFrame, version_col: str, prediction: str, truth: str,
               weights: Mapping[str, float]) -> DataFrame:
    """Per arm: labelled predictions, correct ones (numpy ``isclose``), accuracy (0 when
    none), traffic weight. Rows without ground truth do not count; configured arms without
    labelled rows are listed with zeros."""
    labelled = df.where(F.col(truth).isNotNull())
    agg = labelled.groupBy(F.col(version_col).alias("version")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(is_close(F.col(prediction).cast("double"), F.col(truth).cast("double")))
        .alias("correct_predictions"))
    return with_arms(agg, weights)


def with_arms(counts: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Accuracy and traffic weight of counted arms. A static table also gets the configured
    arms it lacks, with zeros; a stream cannot emit what has not arrived."""
    if counts.isStreaming:
        w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        both = counts.withColumn("traffic_weight", w[F.col("version")])
    else:
        arms = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "version string, traffic_weight double")
        both = counts.join(arms, "version", "full")           # one row per arm on both sides
    return both.select("version", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_predictions", "correct_predictions")],
                       safe_ratio(F.col("correct_predictions"), F.col("total_predictions")).alias("accuracy"),
                       F.coalesce("traffic_weight", F.lit(0.0)).alias("traffic_weight"))
