"""Running totals along a key that may be far too large for one task.

A plain window `partitionBy(key).orderBy(...)` sorts a whole key in one task.  Here
the order is cut into buckets first:

1. totals per (key, bucket), combined map-side, so only small rows are shuffled;
2. a window over the bucket totals of a key gives each bucket its base;
3. a window inside (key, bucket) adds the local part.

The bucket is a plain function of the row, so a lost executor recomputes the same
one.  With `limit`, buckets that start beyond it are dropped before the rows are
shuffled, which is how a budget or a first-N cut avoids moving the tail of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 16


def ordinal_bucket(ordinal: str = "doc_ord", bits: int = BUCKET_BITS) -> Column:
    """2**bits consecutive ordinals per bucket."""
    return F.shiftright(F.col(ordinal).cast("bigint"), bits)


def hash_bucket(hashed: str, digits: int = 3) -> Column:
    """Leading hex digits of a hash: evenly filled buckets in hash order."""
    return F.substring(F.col(hashed), 1, digits)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column | str, bucket: Column,
    out: str = "before", total: str | None = None, limit: int | None = None, index: str | None = None,
) -> DataFrame:
    """Add `out`, the sum of `value` over earlier rows of the key, 0 for the first row.

    `total` adds the sum of the whole key and `index` the number of earlier rows.
    `limit` drops rows of buckets whose base is already above it; rows at or below the
    limit are all kept.
    """
    value = F.col(value) if isinstance(value, str) else value
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("bigint"))

    sums = tagged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"), F.count("*").alias("_rows"))
    along = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    if index is not None:
        bases = bases.withColumn("_first", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
    if total is not None:
        bases = bases.withColumn(total, F.sum("_sum").over(W.partitionBy(*keys)))
    if limit is not None:
        bases = bases.where(F.col("_base") <= limit)
    bases = bases.drop("_sum", "_rows")

    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = tagged.join(bases, [*keys, "_bucket"])
    local = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    added = joined.withColumn(out, F.col("_base") + local)
    if index is not None:
        place = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
        added = added.withColumn(index, F.col("_first") + place - 1)
    return added.drop("_bucket", "_value", "_base", "_first")


def first_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, bucket: Column, rank: str = "rank",
) -> DataFrame:
    """The first n rows of each key; `rank` counts from 0."""
    ranked = running_total(df, keys, order, F.lit(1), bucket, out=rank, limit=n - 1)
    return ranked.where(F.col(rank) < n)
