"""Serving queries: filtered series, joined frames, markers and extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LITRES_PER_GALLON, STRIP_PAIRS
from ..plans import interval_join
from ..plans.slices import shift
from .derive import pair_diff, pair_ratio
from .resample import resample, summary_stats
from .timeops import range_filter


def load_joined(readings: DataFrame, ratios: DataFrame, weather: DataFrame, ts: str = "ts", ratio_keys: Sequence[str] = ("location", "depth", "variable")) -> DataFrame:
    """Readings with their pair's ratio and the weather of the same instant.

    All three are keyed by the time bin; the big side is shuffled at most once per join and AQE
    broadcasts weather when its measured size allows.
    """
    pair = F.create_map(*[F.lit(x) for a, b in STRIP_PAIRS for x in (a, a, b, a)])
    left = readings.withColumn("treated", pair[F.col("strip")])
    return left.join(ratios.select(ts, *ratio_keys, "treated", "ratio"), [ts, *ratio_keys, "treated"], "left").join(
        weather, ts, "left"
    )


def raw_series(readings: DataFrame, variable: str, strip: str, start: str, end: str, location: str | None = None, depth: str | None = None, ts: str = "ts") -> DataFrame:
    """One strip's series by depth (location given) or by location (depth given), empty series removed.

    Water content in inches is served from VWC by the caller through `swc_depth`.
    """
    if (location is None) == (depth is None):
        raise ValueError("give either a location (series by depth) or a depth (series by location)")
    picked = readings.filter((F.col("variable") == variable) & (F.col("strip") == strip))
    picked = picked.filter(F.col("location") == location) if location else picked.filter(F.col("depth") == depth)
    # a missing value is no point of a series, and a series of missing values vanishes with it
    return range_filter(picked, start, end, ts).filter("value IS NOT NULL").select(
        ts, "strip", "location", "depth", "variable", "value"
    )


def ratio_series(ratios: DataFrame, variable: str, depth: str, location: str, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Both pairs' ratio for one depth and location; SWC is served from the VWC ratio."""
    source = "VWC" if variable == "SWC" else variable
    return range_filter(
        ratios.filter((F.col("variable") == source) & (F.col("depth") == depth) & (F.col("location") == location)),
        start, end, ts, last_day=False,
    ).select(ts, "treated", "control", "ratio")


def temp_delta_series(readings: DataFrame, grain: str, keys: Sequence[str] = ("location", "depth")) -> DataFrame:
    """Treated minus control of resampled soil temperature, both pairs."""
    means = resample(readings.filter("variable = 'T'"), grain)
    return pair_diff(means, ["T"], ["bin", *keys, "variable"]).select("bin", *keys, "treated", "control", "diff")


def rain_series(weather: DataFrame, system: str = "us", ts: str = "ts") -> DataFrame:
    """Rain in the asked system; the other unit fills in where the first is missing."""
    have = set(weather.columns)
    parts = []
    first, other, factor = ("precip_mm", "precip_in", 25.4) if system == "metric" else ("precip_in", "precip_mm", 1 / 25.4)
    if first in have:
        parts.append(F.col(first))
    if other in have:
        parts.append(F.col(other) * F.lit(factor))
    if not parts:
        raise ValueError("no rain column")
    return weather.select(ts, F.coalesce(*parts).alias("rain"))


def irrigation_marks(events: DataFrame, system: str = "us", start: str = "start", gallons: str = "gallons_strip") -> DataFrame:
    """Volume of each event in thousands of gallons or litres."""
    factor = LITRES_PER_GALLON if system == "metric" else 1.0
    return events.filter(F.col(start).isNotNull()).withColumn(
        "volume_k", F.coalesce(F.col(gallons), F.lit(0.0)) * F.lit(factor) / F.lit(1000.0)
    )


def summary_query(readings: DataFrame, ratios: DataFrame, variable: str, strip: str, depth: str, start: str, end: str) -> DataFrame:
    """Statistics of a variable's raw series and of both pairs' ratios on hourly means.

    Ratios are not reported for temperatures.
    """
    raw = range_filter(readings.filter(
        (F.col("variable") == variable) & (F.col("strip") == strip) & (F.col("depth") == depth)
    ), start, end, "bin")
    out = summary_stats(raw, ["strip", "location"]).withColumn("kind", F.lit("raw"))
    if variable in ("T", "temp_air", "temp_soil_5cm", "temp_soil_15cm"):
        return out
    pairs = range_filter(ratios.filter((F.col("variable") == variable) & (F.col("depth") == depth)), start, end, "bin")
    named = pairs.withColumn("strip", F.concat_ws("_", "treated", "control"))
    return out.unionByName(
        summary_stats(named, ["strip", "location"], "ratio").withColumn("kind", F.lit("ratio"))
    )


def ratios_of(readings: DataFrame, keys: Sequence[str] = ("bin", "location", "depth", "variable")) -> DataFrame:
    """Ratio table of resampled readings."""
    return pair_ratio(readings, keys=keys)


def event_extract(readings: DataFrame, events: DataFrame, keys: Sequence[str], hours_before: float = 6.0, hours_after: float = 36.0, weather: DataFrame | None = None, ts: str = "ts", start: str = "start", end: str = "end", gallons: str = "gallons_strip", digits: int | None = None) -> DataFrame:
    """Readings of all depths around each event with the event's flow, and rain where given.

    Duration and flow are rounded to `digits` once an event, before they meet its up to hundreds of readings.
    """
    hours = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(3.6e9)
    windows = events.withColumns({
        "_from": shift(start, -hours_before * 3600), "_to": shift(start, hours_after * 3600),
        "duration_h": hours,
        "avg_flow_gph": F.when(hours > 0, F.col(gallons) / hours),
    })
    if digits is not None:
        windows = windows.withColumns({c: F.round(c, digits) for c in ("duration_h", "avg_flow_gph")})
    out = interval_join(readings.filter("value IS NOT NULL"), windows, keys, ts, "_from", "_to").drop("_from", "_to")
    return out.join(weather, ts, "left") if weather is not None else out
