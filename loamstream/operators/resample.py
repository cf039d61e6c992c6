"""Resampling and summary statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import padded_range
from ..plans import exact_quantiles, latest_before, nearest_join
from ..plans.slices import DAY, as_col, floor_to, micros, shift

GRAIN_SECONDS = {"15min": 900, "hourly": 3600, "daily": DAY}


def bin_of(ts: str | Column, grain: str) -> Column:
    """Bin label: start of the bin, or the month's last day for `monthly`."""
    if grain == "monthly":
        return F.last_day(as_col(ts)).cast("timestamp_ntz")
    return floor_to(ts, GRAIN_SECONDS[grain])


def _is_rain(prefix: str = "precip") -> Column:
    return F.col("variable").startswith(prefix)


def resample(
    df: DataFrame, grain: str, keys: Sequence[str] = ("strip", "location", "depth", "variable"),
    ts: str = "ts", value: str = "value", digits: int | None = 3, is_sum: Column | None = None,
) -> DataFrame:
    """Mean per bin, sum for rain, rounded half to even; a bin with nothing but NULLs is dropped.

    Both aggregates combine before the shuffle, so a hot series costs one row per bin and task.
    """
    is_sum = is_sum if is_sum is not None else _is_rain()
    means = df.withColumn("bin", bin_of(ts, grain)).withColumn("_sum", is_sum).groupBy(*keys, "bin").agg(
        F.max("_sum").alias("_sum"), F.sum(value).alias("_s"), F.count(value).alias("_n")
    ).filter("_n > 0")
    out = F.when(F.col("_sum"), F.col("_s")).otherwise(F.col("_s") / F.col("_n"))
    if digits is not None:
        out = F.bround(out, digits)
    return means.select(*keys, "bin", out.alias(value), F.col("_n").alias("n"))


def resample_filled(
    df: DataFrame, grain: str, keys: Sequence[str], ts: str = "ts", value: str = "value",
    digits: int = 3, is_sum: Column | None = None,
) -> DataFrame:
    """Every bin between a key's first and last one: sums are 0 and means NULL where nothing was read."""
    is_sum = is_sum if is_sum is not None else _is_rain()
    flagged = df.withColumn("_sum", is_sum)
    bins = flagged.withColumn("bin", bin_of(ts, grain)).groupBy(*keys, "bin").agg(
        F.max("_sum").alias("_sum"), F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    span = bins.groupBy(*keys).agg(
        F.min("bin").alias("_a"), F.max("bin").alias("_b"), F.max("_sum").alias("_rain")
    )
    if grain == "monthly":
        months = F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))
        grid = span.select(*keys, "_rain", F.explode(months).alias("_m")).select(
            *keys, "_rain", F.last_day("_m").cast("timestamp_ntz").alias("bin"))
    else:
        step = F.expr(f"interval {GRAIN_SECONDS[grain]} second")
        grid = span.select(*keys, "_rain", F.explode(F.sequence("_a", "_b", step)).alias("bin"))
    full = grid.join(bins, [*keys, "bin"], "left")
    mean = F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))
    out = F.when(F.col("_rain"), F.coalesce(F.col("_s"), F.lit(0.0))).otherwise(mean)
    return full.select(
        *keys, "bin", F.bround(out, digits).alias(value),
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n"),
    )


def resample_bins(
    df: DataFrame, seconds: int, keys: Sequence[str], method: str = "mean", min_samples: int = 1,
    label: str = "end", ts: str = "ts", value: str = "value", order: Sequence[str] = (),
) -> DataFrame:
    """Bins closed and labelled on the same side, with a minimum number of rows.

    Right-closed bins are left-closed bins of the time moved back by one microsecond.
    """
    if label in ("start", "left"):
        at = floor_to(ts, seconds)
    else:
        moved = F.timestamp_micros(micros(ts) - 1).cast("timestamp_ntz")
        at = shift(floor_to(moved, seconds), seconds)
    if method == "mean":
        picked = F.avg(value)
    elif method == "last":
        picked = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(ts, *order)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return (
        df.groupBy(*keys, at.alias("bin"))
        .agg(picked.alias(value), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples)
    )


def resample_nearest(
    df: DataFrame, seconds: int, keys: Sequence[str], max_gap_s: float | None, ts: str = "ts",
    value: str = "value", order: Sequence[str] = (),
) -> DataFrame:
    """The sample closest to each anchor of a regular grid; anchors without a sample in reach drop."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    up = F.timestamp_micros(micros("_b") - 1).cast("timestamp_ntz")
    grid = F.sequence(
        floor_to("_a", seconds), shift(floor_to(up, seconds), seconds),
        F.expr(f"interval {seconds} second"),
    )
    anchors = ends.select(*keys, F.explode(grid).alias("bin"))
    src = df.select(*keys, ts, value, *order).withColumn("sample_ts", F.col(ts))
    near = nearest_join(
        anchors, src, keys, "bin", ts, ["sample_ts", value], max_gap_s, order,
        width=max(seconds * 16, int(max_gap_s or 0), 3600),
    )
    return near.filter(F.col(value).isNotNull()).drop("distance_s")


def summary_stats(
    df: DataFrame, keys: Sequence[str], value: str = "value", digits: int = 4, prefix: str = "",
) -> DataFrame:
    """min, mean, max, sample sd per series; series without values are absent."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.bround(F.min(v), digits).alias(f"{prefix}min"),
        F.bround(F.avg(v), digits).alias(f"{prefix}mean"),
        F.bround(F.max(v), digits).alias(f"{prefix}max"),
        F.bround(F.stddev_samp(v), digits).alias(f"{prefix}std"),
    )


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_series(
    df: DataFrame, keys: Sequence[str], value: str = "value",
    probs: Mapping[str, float] = QUARTILES,
) -> DataFrame:
    """count, mean, sd, min, quantiles, max; the quantiles are exact and spread over value slices."""
    v = F.col(value)
    base = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return base.join(exact_quantiles(df, keys, value, dict(probs)), list(keys))


def build_summary(
    df: DataFrame, period: Column, keys: Sequence[str], measures: Mapping[str, Callable[[Column], Column]],
    value: str = "value",
) -> DataFrame:
    """Period x series summary with caller-given aggregate expressions, one aggregation."""
    return (
        df.withColumn("period_code", period).filter("period_code IS NOT NULL")
        .groupBy("period_code", *keys)
        .agg(*[build(F.col(value)).alias(name) for name, build in measures.items()])
    )


def value_range(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Smallest and largest value, widened when they coincide."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return ends.withColumn("_r", padded_range(F.col("_lo"), F.col("_hi"))).select(
        *keys, F.col("_r.low").alias("low"), F.col("_r.high").alias("high")
    )


def symmetric_range(df: DataFrame, keys: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """Half-width of a zero-centred axis: largest magnitude plus 5 %, 1.05 for a flat series."""
    top = F.max(F.abs(F.col(value)))
    size = F.when(F.coalesce(F.col("_m"), F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.col("_m"))
    return df.groupBy(*keys).agg(top.alias("_m")).select(*keys, (size * F.lit(1.05)).alias("half_range"))


def event_window_range(
    readings: DataFrame, events: DataFrame, keys: Sequence[str], hours_before: float = 6.0,
    hours_after: float = 36.0, by: Sequence[str] = (), ts: str = "ts", value: str = "value",
    start: str = "start", pad: float = 0.05,
) -> DataFrame:
    """Common sensor range of the windows around event starts, padded by 5 % (by 1 if flat).

    All windows are equally long, so a reading lies in one of them exactly when the last start up to
    `hours_before` after it is not older than `hours_after`: an as-of join, however many events overlap.
    """
    starts = events.select(*keys, F.col(start).alias("_start")).distinct().withColumn("_at", F.col("_start"))
    probe = readings.filter(F.col(value).isNotNull()).withColumn("_probe", shift(ts, hours_before * 3600))
    seen = latest_before(probe, starts, keys, "_probe", "_at", ["_start"]).filter(
        F.col("_start") >= shift(ts, -hours_after * 3600))
    ends = seen.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    extra = F.when(width <= 0, F.lit(1.0)).otherwise(width * F.lit(pad))
    return ends.filter("_lo IS NOT NULL").select(
        *by, (F.col("_lo") - extra).alias("low"), (F.col("_hi") + extra).alias("high")
    )
