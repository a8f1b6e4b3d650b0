"""Equi-join of token-like rows with a table of token statistics, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1024
SPREAD = 4096


def hot_stats(stats: DataFrame, weight: str) -> DataFrame:
    """The rows of `stats` with over 1/1024 of the total weight: fewer than 1,024 by arithmetic."""
    total = stats.agg(F.sum(weight)).scalar()
    return stats.where(F.col(weight) * HOT_SHARE > total)


def lookup_weighted(
    rows: DataFrame, stats: DataFrame, key: str, stat_key: str, weight: str, columns: list[str],
    spread_by: list[str],
) -> DataFrame:
    """Left-join `columns` of `stats` to `rows` on rows[key] = stats[stat_key].

    `weight` counts how often a key occurs.  A key with more than 1/1024 of the total
    weight is hot.  There are fewer than 1,024 of these by arithmetic, whatever the
    data, so they can be broadcast.  All other keys go through a shuffle join in which
    none has more than 1/1024 of the rows.  Rows that were served by the broadcast
    take part in the shuffle under a key nobody has, spread by `spread_by`.
    """
    hot = hot_stats(stats, weight).select(
        F.col(stat_key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in columns]
    )
    cold = stats.select(
        F.concat(F.lit("k"), stat_key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in columns],
    )
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.concat(F.lit("s"), F.pmod(F.hash(*spread_by), F.lit(SPREAD)).cast("string"))
    route = F.when(F.col("_hot_key").isNotNull(), salt).otherwise(F.concat(F.lit("k"), key))
    routed = first.withColumn("_route", route)
    both = routed.join(cold, F.col("_route") == F.col("_cold_key"), "left")
    picked = [F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns]
    return both.select(*rows.columns, *picked)
