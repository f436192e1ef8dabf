"""As-of join: each row gets the latest row of a history at or before its time.

The history is put among the rows and the last value is carried on by a window, so no pair of rows is made. The
window is cut by time buckets: a history row is copied to every bucket that it reaches, and a bucket is
dealt over ``salts`` parts, so a bucket that holds a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, ts: str, history: DataFrame, valid_from: str, columns: list[str], by: list[str] | None = None,
          bucket_seconds: int = 86_400, salts: int = 8) -> DataFrame:
    """``rows`` with ``columns`` of the history row (of equal ``by``) that holds at ``ts``: the one of largest ``valid_from`` not
    after it; NULLs before the first, and for rows without a time. At one time and key the history must have one row."""
    by = by or []
    t = lambda c: F.col(c).cast("timestamp")
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    span = rows.agg(F.min(t(ts)).alias("lo"), F.max(t(ts)).alias("hi")).select(bucket(F.col("lo")).alias("lo"), bucket(F.col("hi")).alias("hi")).first()  # two numbers
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, -1)
    held = F.struct(*[F.col(c) for c in columns])
    # until when a row holds: the bucket of the next one of its key
    until = F.lead("_from").over(Window.partitionBy(*by).orderBy("_from")) if by else F.lead("_from").over(Window.orderBy("_from"))
    known = history.select(*by, t(valid_from).alias("_from"), held.alias("_held")).where(F.col("_from").isNotNull()).withColumn("_until", until)
    first = F.greatest(bucket(F.col("_from")), F.lit(lo))
    last = F.least(F.coalesce(bucket(F.col("_until")), F.lit(hi)), F.lit(hi))
    copies = (known.where(first <= last).withColumn("_bucket", F.explode(F.sequence(first, last)))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    own = rows.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    own = own.select(*by, t(ts).alias("_at"), bucket(t(ts)).alias("_bucket"), F.lit(1).alias("_is_row"), "_row",
                     F.pmod(F.xxhash64(t(ts), F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("_salt"))
    both = own.unionByName(copies.select(*by, F.col("_from").alias("_at"), "_bucket", "_salt", F.lit(0).alias("_is_row"), "_held"), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_bucket", "_salt").orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_held", F.when(F.col("_at").isNotNull(), F.last("_held", ignorenulls=True).over(w))).where("_is_row = 1")
    return out.select("_row.*", *[F.col("_held")[c].alias(c) for c in columns])
