"""Running sums over an order, without one task that sees everything.

Rows carry a bucket that follows the order. Sums of buckets are one row each and are accumulated first; the rest is a window
inside each bucket. The number of buckets follows the number of rows, so a task handles about ``ROWS_PER_BUCKET`` of them,
however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kikitori.session import cut

ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 16


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a number of rows."""
    return max(LEAST_BUCKETS, -(-rows // per_bucket))


def hash_bucket(*keys: Column, buckets: int) -> Column:
    """A bucket for orders by hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def range_buckets(df: DataFrame, order: Sequence[str], out: str, rows: int) -> DataFrame:
    """``df``, written once, with a bucket that follows ``order``: ranges of about equally many rows, by a sample of the keys, so
    that hot stretches of an order are cut too."""
    n = bucket_count(rows)
    ranged, _ = cut(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), "ranges")
    return ranged


def prefix_sum(
    df: DataFrame, partition: Sequence[str], bucket: str, order: Sequence[Column | str], weight: str, out: str, total: str | None = None
) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same partition that come before (own row excluded), in
    the order (bucket, order), and with ``total``, if named, the sum over the whole partition. The order must be total for a
    deterministic result. Null weights add nothing; null partition values form a partition of their own; an empty table
    stays empty."""
    keys = [*partition, bucket]
    sums = df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("__ps_t"))
    # one row for each partition and bucket
    every = Window.partitionBy(*(partition or [F.lit(1)]))
    before = every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__ps_t").over(before), F.lit(0)).alias("__ps_before"),
        *([F.sum("__ps_t").over(every).alias("__ps_total")] if total else []),
    )
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__ps_in", F.coalesce(F.sum(F.coalesce(F.col(weight), F.lit(0))).over(inner), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"__p{i}")) for i, k in enumerate(keys)]
    joined = own.join(sums, on).withColumn(out, F.col("__ps_before") + F.col("__ps_in"))
    if total:
        joined = joined.withColumn(total, F.col("__ps_total"))
    return joined.drop("__ps_before", "__ps_in", "__ps_total", *[f"__p{i}" for i in range(len(keys))])
