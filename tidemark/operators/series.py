"""Operators along one monthly series (dataset, model)."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions import fixed

SERIES = ["dataset", "model"]


def along() -> WindowSpec:
    return W.partitionBy(*SERIES).orderBy("month")


def repair_month(results: DataFrame, month: str = fixed.REPAIR_MONTH, value: str = "ratio") -> DataFrame:
    """Replace one month's value by the mean of its neighbours; kept when one is missing."""
    mean = (F.lag(value).over(along()) + F.lead(value).over(along())) / 2
    return results.withColumn(
        "repaired", F.when(F.col("month") == month, F.coalesce(mean, F.col(value))).otherwise(F.col(value))
    )


def _levels(alpha: float):
    """Levels after each point, from the level before them; without one the first point is the first level."""

    @F.pandas_udf("array<double>")
    def levels(points: pd.Series, before: pd.Series) -> pd.Series:
        def fold(xs, y: float) -> list[float]:
            xs = [float(x) for x in xs]
            start, rest = (xs[0], xs[1:]) if math.isnan(y) else (alpha * xs[0] + (1 - alpha) * y, xs[1:])
            return list(accumulate(rest, lambda y, x: alpha * x + (1 - alpha) * y, initial=start))

        return pd.Series([fold(xs, y) for xs, y in zip(points, before.astype(float))])

    return levels


def exponential_smoothing(
    results: DataFrame, alpha: float = fixed.SMOOTHING_ALPHA, value: str = "ratio", keys: list[str] = SERIES, order: str = "month",
    bucket: Column | None = None,
) -> DataFrame:
    """y0 = x0, then y = alpha*x + (1-alpha)*y along `order`; rows without a value are left out.

    A run of points maps the level before it to the one after it by y -> a*y + b, and such maps compose.  So a series is
    cut into buckets, a function of the row that rises with `order` (the year of a month, unless given): each bucket is
    folded from zero, the few (a, b) of a series are folded in turn, and then each bucket from its own first level.
    No series has to fit a task; a bucket has.
    """
    levels = _levels(alpha)
    placed = results.where(F.col(value).isNotNull()).withColumn("_bucket", F.substring(order, 1, 4) if bucket is None else bucket)
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x"))))
    runs = placed.groupBy(*keys, "_bucket").agg(points.alias("_points"))
    xs = F.transform("_points", lambda p: p["x"])
    maps = runs.select(
        *keys, "_bucket", F.pow(F.lit(1 - alpha), F.size("_points")).alias("a"),
        F.element_at(levels(xs, F.lit(0.0)), -1).alias("b"), F.element_at(levels(xs, F.lit(None).cast("double")), -1).alias("own"),
    )
    # One row per bucket of a series: the level that each hands on to the next.
    steps = F.array_sort(F.collect_list(F.struct("_bucket", "a", "b", "own")))
    handed = F.aggregate(
        F.slice("_steps", 2, F.size("_steps")), F.array(F.col("_steps")[0]["own"]),
        lambda ys, s: F.concat(ys, F.array(s["a"] * F.element_at(ys, -1) + s["b"])),
    )
    chain = maps.groupBy(*keys).agg(steps.alias("_steps")).withColumn("_handed", handed)
    before = chain.select(*keys, F.posexplode("_steps").alias("_i", "_s"), "_handed").select(
        *keys, F.col("_s._bucket").alias("_bucket"),
        F.when(F.col("_i") > 0, F.element_at("_handed", F.greatest(F.col("_i"), F.lit(1)))).alias("_before"),
    )
    folded = runs.join(before, [*keys, "_bucket"]).withColumn("_ys", levels(xs, F.col("_before")))
    each = folded.select(*keys, F.explode_outer(F.arrays_zip("_points", "_ys")).alias("_row"))
    return each.select(*keys, F.col("_row._points.at").alias(order), F.col("_row._ys").alias("smoothed"))


def drift_vs_first(results: DataFrame, value: str = "ratio") -> DataFrame:
    """Relative change against the first month of the series."""
    whole = along().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return results.withColumn("drift", F.try_divide(F.col(value), F.first(value).over(whole)) - 1)


def cumulative_time(results: DataFrame, value: str = "time_used") -> DataFrame:
    """Elapsed time as it adds up from month to month."""
    return results.withColumn("elapsed", F.sum(value).over(along().rowsBetween(W.unboundedPreceding, 0)))
