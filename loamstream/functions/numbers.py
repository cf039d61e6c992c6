"""Missing values, guarded division and bounds. NULL is the only missing marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import RATIO_EPS


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """Text to double, anything unreadable to NULL."""
    return nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def div(num: Column, den: Column) -> Column:
    """Quotient, NULL for a zero denominator (ANSI division would fail the job)."""
    return num / F.when(den != 0, den)


def safe_ratio(num: Column, den: Column, eps: float = RATIO_EPS) -> Column:
    """Quotient, NULL where the denominator is closer to zero than `eps`."""
    return num / F.when(F.abs(den) >= F.lit(eps), den)


def bounded(c: Column, low: Column | None, high: Column | None, inclusive: bool = True) -> Column:
    """True where `c` lies outside its bounds; a NULL bound does not bind."""
    if inclusive:
        out = (c < low, c > high)
    else:
        out = (c <= low, c >= high)
    return F.coalesce(out[0], F.lit(False)) | F.coalesce(out[1], F.lit(False))


def padded_range(low: Column, high: Column, pad: float = 0.1) -> Column:
    """Struct (low, high), widened when degenerate: (0, 1) at zero, else by a share of the value."""
    same = low == high
    return F.struct(
        F.when(same & (low == 0), F.lit(0.0)).when(same, low - F.abs(low) * pad).otherwise(low).alias("low"),
        F.when(same & (low == 0), F.lit(1.0)).when(same, high + F.abs(low) * pad).otherwise(high).alias("high"),
    )
