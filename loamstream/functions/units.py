"""Unit conversion by column-name suffix, and planar distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LITRES_PER_GALLON


def to_fahrenheit(c: Column) -> Column:
    return c * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def to_celsius(c: Column) -> Column:
    return (c - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


# fixed values: which suffix means which quantity, longest suffix first, and the metric twin's suffix
SUFFIXES: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    ("_swc_in", "_swc_cm", lambda c: c * F.lit(2.54)),
    ("_degF", "_degC", to_celsius),
    ("_gal", "_L", lambda c: c * F.lit(LITRES_PER_GALLON)),
    ("_in", "_mm", lambda c: c * F.lit(25.4)),
)


def converted(name: str, system: str) -> Column:
    """The column in the asked system; stored values are US units."""
    if system not in ("us", "metric"):
        raise ValueError(f"unknown unit system {system!r}")
    c = F.col(name)
    if system == "metric":
        for suffix, _, convert in SUFFIXES:
            if name.endswith(suffix):
                return convert(c)
    return c


def distance_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance in feet, good for one field: 364 000 ft per degree of latitude."""
    per_degree = F.lit(364000.0)
    dx = (lon2 - lon1) * per_degree * F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    dy = (lat2 - lat1) * per_degree
    return F.sqrt(dx * dx + dy * dy)
