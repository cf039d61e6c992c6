"""Gaps, continuity, missing values, battery health, runs and episodes.

Copies of an instant are reduced to (key, instant, count) before any ordering, and ordering happens
inside time slices, so neither a hot logger nor a block of copies lands in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import bounded
from ..plans import exact_quantiles, flag_runs, lag_in_time, lag_where, null_safe_join, top_rows
from ..plans.slices import DAY, floor_to, micros, minutes_between, shift, slice_of
from ..session import cut_lineage

ROW_BLOCK = 1_000_000


def instants(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Distinct instants per key with their number of rows."""
    return df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("copies"))


def steps(df: DataFrame, keys: Sequence[str], ts: str = "ts", width: int = DAY) -> DataFrame:
    """Distinct instants with the previous one and the step in minutes."""
    out = lag_in_time(instants(df, keys, ts), keys, [ts], {ts: "prev_ts"}, width)
    return out.withColumn("step_min", minutes_between(ts, "prev_ts"))


def gaps(df: DataFrame, keys: Sequence[str], minutes: float = 60.0, ts: str = "ts") -> DataFrame:
    """Steps of at least `minutes`, a positive number."""
    step = minutes_between(ts, "prev_ts")
    return lag_where(df.filter(F.col(ts).isNotNull()).select(*keys, ts), keys, [ts], {ts: "prev_ts"}, step >= minutes).select(
        *keys, F.col("prev_ts").alias("gap_start"), F.col(ts).alias("gap_end"), step.alias("gap_minutes")
    )


def continuity(df: DataFrame, keys: Sequence[str], cadence_min: float = 15.0, ts: str = "ts") -> DataFrame:
    """Points, duplicates, gaps, odd steps, largest gap, and missing points of the ideal grid."""
    s = F.col("step_min")
    out = steps(df, keys, ts).groupBy(*keys).agg(
        F.sum("copies").alias("n_points"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.sum(F.col("copies") - 1).alias("n_duplicates"), F.count_if(s > cadence_min).alias("n_gaps"),
        F.count_if((s != 0) & (F.pmod(s, F.lit(cadence_min)) != 0)).alias("n_odd_steps"),
        # a step of zero exists wherever an instant is repeated
        F.greatest(F.max(s), F.when(F.max("copies") > 1, F.lit(0.0))).alias("max_gap_min"),
    )
    grid = F.floor(minutes_between("last_ts", "first_ts") / F.lit(cadence_min)) + 1
    out = out.withColumn("expected_points", grid.cast("bigint"))
    out = out.withColumn("missing_points", F.greatest(F.col("expected_points") - F.col("n_points"), F.lit(0)).cast("bigint"))
    return out.withColumn("pct_missing", F.lit(100.0) * F.col("missing_points") / F.col("expected_points"))


def worst(df: DataFrame, by: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The `n` worst offenders of a report."""
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n)


def cadence(df: DataFrame, keys: Sequence[str], cadence_min: float, ts: str = "ts") -> DataFrame:
    """Count, gaps beyond the cadence plus 30 s, duplicates, smallest and largest step."""
    s = F.col("step_min")
    dupes = F.sum(F.col("copies") - 1)
    zero = F.when(dupes > 0, F.lit(0.0))
    return steps(df, keys, ts).groupBy(*keys).agg(
        F.sum("copies").alias("n"), F.count_if(s > cadence_min + 0.5).alias("gaps"), dupes.alias("dupes"),
        F.least(F.min(s), zero).alias("min_step_min"), F.greatest(F.max(s), zero).alias("max_step_min"),
    )


def file_block(row_no: str) -> Column:
    """Block of a file's rows; blocks are the slices of file order."""
    return F.floor(F.col(row_no) / F.lit(ROW_BLOCK)).cast("bigint")


def file_steps(df: DataFrame, keys: Sequence[str], ts: str = "ts", row_no: str = "row_no", also: Sequence[str] = ()) -> DataFrame:
    """Rows with the previous row's time in file order and the step in minutes."""
    take = {ts: "prev_ts", **{c: f"prev_{c}" for c in also}}
    out = lag_in_time(df, keys, [row_no], take, by=file_block(row_no))
    return out.withColumn("step_min", minutes_between(ts, "prev_ts"))


def time_health(df: DataFrame, keys: Sequence[str], ts: str = "ts", row_no: str = "row_no", multiplier: float = 3.0) -> DataFrame:
    """Inferred step (median positive difference in file order), duplicates, backward steps, large gaps.

    Differences are counted by value first; the median and the gap counts then read that histogram.
    """
    # a row per key and step: what follows reads it several times, so it is written once
    hist = cut_lineage(file_steps(df.select(*keys, ts, row_no), keys, ts, row_no).groupBy(*keys, "step_min").agg(
        F.count(F.lit(1)).alias("n")))
    rows = hist.groupBy(*keys).agg(F.sum("n").alias("n_rows"))
    positive = hist.filter("step_min > 0")
    step = weighted_median(positive, keys, "step_min", "n", "inferred_step_min")
    rows = null_safe_join(rows, step, keys, "left").withColumn(
        "inferred_step_min", F.when(F.col("n_rows") >= 3, F.col("inferred_step_min")))
    limit = F.coalesce(F.col("inferred_step_min"), F.lit(15.0)) * F.lit(multiplier)
    graded = null_safe_join(hist, rows, keys).withColumn("_large", F.col("step_min") > limit)
    n = F.col("n")
    found = graded.groupBy(*keys, "n_rows", "inferred_step_min").agg(
        F.coalesce(F.sum(F.when(F.col("step_min") < 0, n)), F.lit(0)).alias("n_nonmonotonic"),
        F.coalesce(F.sum(F.when(F.col("_large"), n)), F.lit(0)).alias("n_large_gaps"),
        F.max(F.when(F.col("_large"), F.col("step_min"))).alias("largest_gap_min"),
    )
    dupes = instants(df, keys, ts).groupBy(*keys).agg(F.sum(F.col("copies") - 1).alias("n_duplicates"))
    return null_safe_join(found, dupes, keys)


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Exact median of values given with their counts."""
    return exact_quantiles(df, keys, value, {name: 0.5}, weight)


def missingness(df: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """Missing values per column; all columns, or the `n` with most."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["_n"], list(columns), "column", "nan_count")
    out = long.select("column", "nan_count", (F.col("nan_count") / F.when(F.col("_n") > 0, F.col("_n"))).alias("nan_fraction"))
    return out if n is None else worst(out, "nan_count", n, ["column"])


BATTERY_QUANTILES = {"p01": 0.01, "p50": 0.5, "p99": 0.99}


def battery_health(df: DataFrame, keys: Sequence[str], low: float = 11.0, high: float = 13.0, value: str = "value") -> DataFrame:
    """Range, exact quantiles and share out of range per battery."""
    v = F.col(value)
    rows = df.filter(v.isNotNull())
    out_of = (v < low) | (v > high)
    base = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min_v"), F.max(v).alias("max_v"),
        F.count_if(out_of).alias("out_of_range_count"), F.avg(out_of.cast("double")).alias("out_of_range_fraction"),
    )
    return null_safe_join(base, exact_quantiles(rows, keys, value, BATTERY_QUANTILES), keys)


def battery_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str], low: float = 11.0, high: float = 13.0, n: int | None = None, value: str = "value") -> DataFrame:
    """Out-of-range readings per battery with the side they fall on; all, or the first `n` in order."""
    v = F.col(value)
    bad = df.filter((v < low) | (v > high)).withColumn("reason", F.when(v < low, "below_min").otherwise("above_max"))
    return bad if n is None else top_rows(bad, keys, [F.col(c) for c in order], n)


def logger_health(df: DataFrame, keys: Sequence[str], since: str, min_volts: float = 11.5, max_gap_min: float = 60.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """GOOD, LOW_VOLTAGE or GAP per year and logger; GAP wins.

    Missing share is against all instants of the year, as on the common time line of a wide frame.
    """
    rows = df.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz")).withColumn("year", F.year(ts))
    total = rows.select("year", ts).distinct().groupBy("year").agg(F.count(F.lit(1)).alias("n_total"))
    volts = rows.filter(F.col(value).isNotNull()).groupBy("year", *keys, ts).agg(F.min(value).alias("_v"))
    lagged = lag_in_time(volts, ["year", *keys], [ts], {ts: "prev_ts"})
    stats = lagged.groupBy("year", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max(minutes_between(ts, "prev_ts")).alias("max_gap_min"),
    ).join(total, "year")
    low = F.col("_min") < min_volts
    whole = F.coalesce(F.col("max_gap_min") <= max_gap_min, F.lit(False))
    return stats.select(
        "year", *keys, F.bround("_min", 3).alias("min_voltage"), low.alias("any_below_threshold"),
        F.bround(F.lit(100.0) * (F.lit(1.0) - F.col("_n") / F.col("n_total")), 2).alias("pct_missing"),
        whole.alias("continuous_record"), "max_gap_min",
        F.when(~whole, "GAP").when(low, "LOW_VOLTAGE").otherwise("GOOD").alias("status"),
    )


# fixed values: physical bounds in raw logger units
RAW_RULES = {"VWC": (0.0, 1.0), "T": (-50.0, 80.0), "EC": (0.0, 20.0), "BattV_Min": (0.0, 20.0)}


def range_violations(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]] = RAW_RULES, sentinel: float = 10000.0, key: str = "variable", value: str = "value") -> DataFrame:
    """Readings outside physical bounds, sentinels not counted."""
    entries = [x for k, (lo, hi) in rules.items() for x in (F.lit(k), F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")))]
    rule = F.create_map(*entries)[F.col(key)]
    v = F.when(F.abs(F.col(value)) < sentinel, F.col(value))
    return df.filter(rule.isNotNull() & bounded(v, rule["lo"], rule["hi"]))


def violation_summary(violations: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("violation_count"), F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))


def threshold_runs(df: DataFrame, keys: Sequence[str], flag: Column, order: Sequence[str] = ("ts",), value: str = "value", width: int = DAY) -> DataFrame:
    """Contiguous runs of rows satisfying `flag`: start, end, points, range, time of the first maximum."""
    return flag_runs(df.filter(F.col(value).isNotNull()), keys, order, {"run": flag}, value, width).drop("kind")


def daily_steps(df: DataFrame, keys: Sequence[str], step: float = 0.6, min_days: int = 10, ts: str = "ts", value: str = "value") -> DataFrame:
    """Upward steps of the daily minimum, for series with at least `min_days` days.

    After the daily minimum a series is as long as its days, so one window per key is bounded.
    """
    days = df.filter(F.col(value).isNotNull()).groupBy(*keys, floor_to(ts, DAY).alias("day")).agg(F.min(value).alias("daily_min"))
    return _day_steps(days, keys, step, min_days)


def _day_steps(days: DataFrame, keys: Sequence[str], step: float, min_days: int) -> DataFrame:
    key = Window.partitionBy(*keys)
    lagged = days.withColumns({"_prev": F.lag("daily_min").over(key.orderBy("day")), "_days": F.count(F.lit(1)).over(key)})
    return lagged.withColumn("delta_v", F.col("daily_min") - F.col("_prev")).filter(
        (F.col("_days") >= min_days) & (F.col("delta_v") >= step)).select(*keys, "day", "daily_min", "delta_v")


def voltage_events(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",), brownout: float = 9.6, warn: float = 16.0, critical: float = 18.0, gap_minutes: float = 60.0, step: float = 0.6, value: str = "value") -> DataFrame:
    """One log of gaps, brown-outs, high-voltage runs and replacement steps with severity.

    Two passes: one for the runs of all three limits, one in which a slice is a day, so that its first and last
    rows give the gaps and its last row carries the day's minimum.
    """
    ts, v, none = order[0], F.col(value), F.lit(None).cast("double")
    flags = {"brownout": v < brownout, "high_voltage_warn": v >= warn, "high_voltage_critical": v >= critical}
    critical_run, low = F.col("kind") == "high_voltage_critical", F.col("kind") == "brownout"
    runs = flag_runs(df.filter(v.isNotNull()), keys, order, flags, value).select(
        *keys, "kind", F.when(critical_run, "critical").otherwise("warn").alias("severity"), "start", "end",
        F.when(low, F.col("min_value")).alias("min_v"), F.when(~low, F.col("max_value")).alias("max_v"), none.alias("gap_minutes"), none.alias("delta_v"))

    day = Window.partitionBy(*keys, "day")
    local = df.filter(F.col(ts).isNotNull()).select(*keys, ts, value, floor_to(ts, DAY).alias("day")).withColumns({
        "_prev": F.lag(ts).over(day.orderBy(ts)), "_end": F.lead(ts).over(day.orderBy(ts)).isNull(), "_low": F.min(value).over(day)})
    gap = lambda prev: F.coalesce(minutes_between(ts, prev) >= gap_minutes, F.lit(False))
    edge = F.col("_prev").isNull() | F.col("_end")
    cut = local.withColumn("_edge", edge).filter(F.col("_edge") | gap("_prev"))
    near = Window.partitionBy(*keys, "_edge", F.when(~F.col("_edge"), F.col("day")))
    days = F.col("_end") & F.col("_low").isNotNull()
    lows = F.last(F.when(days, F.col("_low")), ignorenulls=True).over(near.orderBy(ts, "_end").rowsBetween(Window.unboundedPreceding, -1))
    known = cut.withColumns({
        "_prev": F.coalesce("_prev", F.when(F.col("_edge"), F.lag(ts).over(near.orderBy(ts, "_end")))),
        "_delta": F.when(days, F.col("_low") - lows), "_days": F.count_if(days).over(near)})
    entry = lambda kind, start, end, minutes, delta: F.struct(
        F.lit(kind).alias("kind"), F.lit("info").alias("severity"), start.alias("start"), end.alias("end"), none.alias("min_v"), none.alias("max_v"),
        minutes.alias("gap_minutes"), delta.alias("delta_v"))
    found = F.filter(F.array(
        F.when(gap("_prev"), entry("gap", F.col("_prev"), F.col(ts), minutes_between(ts, "_prev"), none)),
        F.when(F.col("_end") & (F.col("_days") >= 10) & (F.col("_delta") >= step), entry("replacement_step", F.col("day"), F.col("day"), none, F.col("_delta"))),
    ), lambda x: x.isNotNull())
    return runs.unionByName(known.select(*keys, F.explode(found).alias("_e")).select(*keys, "_e.*"))


def sensor_qa(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",), high: float = 50.0, very_high: float = 55.0, low: float = 1.0, jump: float = 10.0, per_hour: float = 4.0, value: str = "value", width: int = DAY) -> DataFrame:
    """Counts beyond limits, large jumps, number of episodes and the longest one per sensor.

    Two passes: the runs of all limits give episodes and their lengths; large jumps and the rest come with the lag.
    """
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*keys, *order, value)
    flags = {f"gt_{high:g}": v > high, f"gt_{very_high:g}": v > very_high, f"lt_{low:g}": v < low}
    kind, points = F.col("kind"), F.col("n_points")
    runs = flag_runs(rows, keys, order, flags, value, width).groupBy(*keys).agg(
        *[F.count_if(kind == n).alias(f"_n_{n}") for n in flags], *[F.max(F.when(kind == n, points)).alias(f"_m_{n}") for n in flags])
    inside = Window.partitionBy(*keys, "_slice")
    local = rows.withColumn("_slice", slice_of(order[0], width)).withColumns({
        "_prev": F.lag(v).over(inside.orderBy(*order)), "_at": F.struct(*order)})
    tie = F.struct(v, -micros(order[0]))
    parts = local.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("n_obs"), F.max(F.struct(tie.alias("k"), F.col(order[0]).alias("t"))).alias("_top"), *[F.count_if(f).alias(f"count_{n}") for n, f in flags.items()],
        F.count_if(F.abs(v - F.col("_prev")) > jump).alias("_jumps"), F.min_by(v, "_at").alias("_first_v"), F.max_by(v, "_at").alias("_last_v"))
    before = F.lag("_last_v").over(Window.partitionBy(*keys).orderBy("_slice"))
    parts = parts.withColumn("_jumps", F.col("_jumps") + F.coalesce((F.abs(F.col("_first_v") - before) > jump).cast("int"), F.lit(0)))
    base = parts.groupBy(*keys).agg(
        F.sum("n_obs").alias("n_obs"), F.max("_top").alias("_top"), *[F.sum(f"count_{n}").alias(f"count_{n}") for n in flags], F.sum("_jumps").alias("count_large_jump"))
    joined = null_safe_join(base, runs, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return joined.select(
        *keys, "n_obs", F.col("_top.k")[value].alias("max_value"), F.col("_top.t").alias("max_ts"), *[f"count_{n}" for n in flags], "count_large_jump",
        *[zero(f"_n_{n}").alias(f"episodes_{n}") for n in flags],
        *[c for n in list(flags)[:2] for c in (zero(f"_m_{n}").alias(f"longest_pts_{n}"), F.bround(zero(f"_m_{n}") / F.lit(per_hour), 2).alias(f"longest_hrs_{n}"))])


def episodes(df: DataFrame, keys: Sequence[str], threshold: float, order: Sequence[str] = ("ts",), per_hour: float = 4.0, value: str = "value") -> DataFrame:
    """Contiguous stretches above a threshold with length in hours at the logger cadence."""
    return threshold_runs(df, keys, F.col(value) > threshold, order, value).withColumn(
        "duration_hours", F.col("n_points") / F.lit(per_hour))


def by_hour(df: DataFrame, threshold: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """How often each hour of day exceeds a threshold."""
    return df.filter(F.col(value) > threshold).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def pick_voltage_column(columns: Sequence[str], patterns: Sequence[str] = ("battv_min", "battv", "volt", "batt")) -> str | None:
    """The column that looks most like battery voltage, by order of preference."""
    for p in patterns:
        for c in columns:
            if p in c.lower():
                return c
    return None


def voltage_window(df: DataFrame, at: str, months: int = 2, ts: str = "ts") -> DataFrame:
    """Rows within `months` of a moment, tagged with their year."""
    mid = F.lit(at).cast("timestamp_ntz")
    lo, hi = F.add_months(mid, -months).cast("timestamp_ntz"), F.add_months(mid, months).cast("timestamp_ntz")
    tod = micros(mid) - micros(F.to_date(mid).cast("timestamp_ntz"))
    lo, hi = shift(lo, tod / 1e6), shift(hi, tod / 1e6)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= hi)).withColumn("year", F.year(ts))
