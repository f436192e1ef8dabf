"""Running totals over a global order without funnelling the data into one task.

A window ``partitionBy(key).orderBy(x)`` puts a whole key — for a global order, the whole
table — into one task. Instead:

1. range-partition on (keys, order) and tag each row with its partition id; the tagged
   table is checkpointed so the tag survives task retries and executor loss;
2. per (partition, key) totals form a table of at most #partitions + #keys rows; an
   exclusive running sum over it gives each slice its offset;
3. each slice computes its local running sum (window over (partition, key) — bounded by
   the range-partition size) and adds its offset (broadcast when there are no keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.columns import null_safe_join, number


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                   num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add inclusive running sums ``cum_<v>`` of ``values`` per ``keys`` ordered by ``order``.

    ``order`` must make rows unique within a key (aggregate duplicates first).
    """
    return running_totals_and_sums(df, keys, order, values, num_partitions, checkpoint)[0]


def running_totals_and_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                            num_partitions: int | None = None, checkpoint: bool = True
                            ) -> tuple[DataFrame, DataFrame]:
    """``running_totals`` plus the per-key grand totals ``tot_<v>``, derived from the tiny
    slice-totals table (so the input is not scanned again for them)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *[F.col(c) for c in keys + order])
              .withColumn("_pid", F.spark_partition_id()))
    if checkpoint:
        from sparkfeat.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    slice_totals = tagged.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_off = (Window.partitionBy(*keys).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1)) if keys else \
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_totals.select(
        "_pid", *keys, *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}")
                         for v in values])
    w_loc = (Window.partitionBy("_pid", *keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
    local = tagged.withColumns({f"_l_{v}": F.sum(v).over(w_loc) for v in values})
    # offsets has one row per (partition, key) slice, at most #partitions + #keys rows.
    # Without keys that bound is the partition count, so it is broadcast; with keys the
    # planner's runtime size check (AQE) decides.
    joined = null_safe_join(local, F.broadcast(offsets) if not keys else offsets, ["_pid", *keys])
    out = joined.select(*df.columns, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}")
                                       for v in values])
    totals = slice_totals.groupBy(*keys).agg(*[F.sum(f"_t_{v}").alias(f"tot_{v}") for v in values])
    return out, totals


def keyed_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float],
                    num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / ``quantile_cont`` definition) of
    ``value`` per ``keys`` without holding a group's values in one buffer.

    Values are counted per distinct (keys, value) — map-side combined, so a hot value is one
    row per task — then ranked with ``running_totals``. The value at 0-based rank r is the
    smallest value whose running count exceeds r; the quantile at p interpolates between
    ranks floor(h) and ceil(h), h = (n-1)·p. ``weight`` names a column of row counts. NULL keys
    are keys; NULL, NaN and non-numeric values are skipped. Output: keys…, p, quantile (groups
    without values are absent).
    """
    times = F.col(weight) if weight else F.lit(1)
    counts = (long.select(*keys, number(value).alias("value"), times.alias("n")).where(F.col("value").isNotNull())
              .groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    cum, sums = running_totals_and_sums(counts, keys, ["value"], ["n"], num_partitions)
    # targets: one row per (key, p)
    targets = (sums.select(*keys, "tot_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
               .select(*keys, "p", ((F.col("tot_n") - 1) * F.col("p")).alias("h"))
               .select(*keys, "p", "h", F.floor("h").alias("r_lo"), F.ceil("h").alias("r_hi")))
    if not keys:
        raise ValueError("keyed_quantiles needs at least one key column")
    hit = null_safe_join(cum, targets, keys).where(F.col("cum_n") > F.col("r_lo"))   # rows for both ranks
    picked = hit.groupBy(*keys, "p", "h", "r_lo").agg(
        F.min("value").alias("v_lo"),
        F.min(F.when(F.col("cum_n") > F.col("r_hi"), F.col("value"))).alias("v_hi"))
    q = F.col("v_lo") + (F.col("h") - F.col("r_lo")) * (F.col("v_hi") - F.col("v_lo"))
    return picked.select(*keys, "p", q.alias("quantile"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    num_partitions: int | None = None) -> DataFrame:
    """``keyed_quantiles`` of several columns at once (key = column name).
    Output: feature, p, quantile (NULL when the column has no values)."""
    spark = df.sparkSession
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in cols])))
    picked = keyed_quantiles(long, ["feature"], "value", probs, num_partitions)
    # one row per (column, p): bounded by #columns × #probabilities
    all_targets = spark.createDataFrame([(c, float(p)) for c in cols for p in probs], "feature string, p double")
    return all_targets.join(picked, ["feature", "p"], "left")
