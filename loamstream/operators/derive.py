"""Volumes, treated-minus-control differences, ratios, profile water and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..fixed_values import (
    ACRE_FT2, CYLINDER_GAL, CYLINDER_L, DEPTH_INCHES, GALLONS_PER_FT3, RATIO_EPS, STRIP_PAIRS,
)
from ..functions import div, safe_ratio
from ..plans import pair_values


def swc_volume(df: DataFrame) -> DataFrame:
    """Water in one probe's cylinder, litres and gallons, as new variables of the long table."""
    both = F.array(
        F.struct(F.lit("SWC_vol_L").alias("variable"), F.lit(CYLINDER_L).alias("k")),
        F.struct(F.lit("SWC_vol_gal").alias("variable"), F.lit(CYLINDER_GAL).alias("k")),
    )
    return (
        df.filter("variable = 'VWC'").withColumn("_m", F.explode(both))
        .withColumn("variable", F.col("_m.variable"))
        .withColumn("value", F.col("value") / F.lit(100.0) * F.col("_m.k")).drop("_m")
    )


PAIR_KEYS = ("ts", "location", "depth", "variable")


def pair_diff(
    df: DataFrame, variables: Sequence[str], keys: Sequence[str] = PAIR_KEYS,
    pairs: Sequence[tuple[str, str]] = STRIP_PAIRS,
) -> DataFrame:
    """Treated minus control per key and pair; NULL when one side is missing."""
    sides = pair_values(df.filter(F.col("variable").isin(*variables)), keys, "strip", pairs)
    return sides.withColumn("diff", F.col("treated_value") - F.col("control_value"))


def pair_ratio(
    df: DataFrame, variables: Sequence[str] = ("VWC", "EC", "SWC_vol_gal"),
    keys: Sequence[str] = PAIR_KEYS, pairs: Sequence[tuple[str, str]] = STRIP_PAIRS,
    eps: float | None = RATIO_EPS,
) -> DataFrame:
    """Treated over control; `eps=None` is the unguarded variant (zero denominator gives NULL)."""
    sides = pair_values(df.filter(F.col("variable").isin(*variables)), keys, "strip", pairs)
    num, den = F.col("treated_value"), F.col("control_value")
    return sides.withColumn("ratio", div(num, den) if eps is None else safe_ratio(num, den, eps))


def swc_depth(df: DataFrame, system: str = "us", inches: Mapping[str, float] = DEPTH_INCHES) -> DataFrame:
    """Equivalent water depth of a probe: percent of its depth in inches (or centimetres)."""
    table = F.create_map(*[x for d, i in inches.items() for x in (F.lit(d), F.lit(float(i)))])
    factor = 2.54 if system == "metric" else 1.0
    return df.filter("variable = 'VWC'").withColumn(
        "water_depth", F.col("value") / F.lit(100.0) * table[F.col("depth")] * F.lit(factor)
    )


def profile_volume(df: DataFrame, keys: Sequence[str], area: float, theta: str = "theta", z: str = "z") -> DataFrame:
    """Water volume of a profile by the trapezoid rule over depth, and the depth-weighted mean.

    A profile has a handful of depths, so the window group is bounded.
    """
    w = Window.partitionBy(*keys).orderBy(z)
    thickness = F.lead(z).over(w) - F.col(z)
    layer = (F.col(theta) + F.lead(theta).over(w)) / F.lit(2.0) * thickness
    return (
        df.select(*keys, layer.alias("_layer"), thickness.alias("_dz"))
        .groupBy(*keys)
        .agg(
            (F.sum("_layer") * F.lit(area)).alias("volume"),
            div(F.sum("_layer"), F.sum("_dz")).alias("mean_theta"),
        )
    )


def runoff(applied: Column, storage_before: Column, storage_after: Column) -> Column:
    """Applied water that the soil did not take up."""
    return applied - (storage_after - storage_before)


def to_rate(df: DataFrame, width_ft: Column, length_ft: Column) -> DataFrame:
    """Per-acre, inches applied and flow per foot of width, from `total_lb`, `gallons`, `gpm`.

    Geometry is a column so every strip brings its own.
    """
    acres = width_ft * length_ft / F.lit(ACRE_FT2)
    per_acre_inch = F.lit(ACRE_FT2 / 12.0 * GALLONS_PER_FT3)
    return df.withColumns({
        "lb_per_acre": F.col("total_lb") / acres,
        "total_lb_back": F.col("total_lb") / acres * acres,
        "inches_applied": F.col("gallons") / acres / per_acre_inch,
        "gpm_per_ft": F.col("gpm") / width_ft,
    })
