"""Number formats of the result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_digits(x: Column, digits: int = 4) -> Column:
    """Below one: `digits` decimals, no leading zero.  Else: `digits` significant figures."""
    below = F.regexp_replace(F.format_string(f"%.{digits}f", x), "^0+", "")
    # Significant figures: the decimals that the integer part leaves.
    whole = F.length(F.floor(F.abs(x)).cast("string"))
    above = F.lit(None).cast("string")
    for n in range(digits, 0, -1):
        above = F.when(whole == n, F.format_string(f"%.{digits - n}f", x)).otherwise(above)
    # Rounding up to the next power of ten leaves one decimal too many.
    carried = F.length(F.replace(above, F.lit("."), F.lit(""))) > digits
    above = F.when(carried, F.regexp_replace(above, r"\.?.$", "")).otherwise(above)
    large = F.coalesce(above, F.format_string("%.0f", x))
    return F.when(x < 1, below).otherwise(large)


def arrow(diff: Column) -> Column:
    return F.when(diff > 0, F.lit("↑")).when(diff <= 0, F.lit("↓"))


def plain_decimals(x: Column, digits: int = 4) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), "^0+", "")


def with_gap(value: Column, gap: Column, value_digits: int = 4, gap_digits: int = 3) -> Column:
    """'{value} {arrow} {gap}' as the result tables print it; without a gap the value, without a value NULL."""
    text = F.concat_ws(" ", fixed_digits(value, value_digits), arrow(gap), fixed_digits(F.abs(gap), gap_digits))
    return F.when(value.isNotNull(), text)
