"""Calendar months as 'yyyy-MM' keys, which sort like time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(date: Column) -> Column:
    """The text of a date begins with its month; cheaper than a date format per row."""
    return F.substring(F.to_date(date).cast("string"), 1, 7)


def first_day(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def shift_months(date: Column, months: int) -> Column:
    return F.add_months(F.to_date(date), months)


def month_number(month: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per month between two month columns, both included."""
    step = F.expr("interval 1 month")
    months = F.sequence(first_day(F.col(start)), first_day(F.col(end)), step)
    rest = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*rest, F.explode(months).alias("_day")).select(
        *rest, month_of(F.col("_day")).alias("month")
    )
