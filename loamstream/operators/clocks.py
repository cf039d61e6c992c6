"""Clock set events, offsets and clock modes from timestamps in file order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import lag_where, running_total
from ..plans.slices import minutes_between, shift
from ..session import cut_lineage
from .quality import ROW_BLOCK, file_block


@dataclass(frozen=True)
class ClockLimits:
    """Minutes; a forward set of an hour on a 15-minute cadence shows as 75, a backward one as −45."""

    forward: tuple[float, float] = (65.0, 95.0)
    backward: tuple[float, float] = (-95.0, -35.0)
    out_of_order: float = 30.0
    downtime: float = 120.0


def classify_step(step: Column, limits: ClockLimits = ClockLimits()) -> Column:
    """Kind of a step, explicit clock sets first; NULL for an ordinary one."""
    return (
        F.when(step.between(*limits.forward), "setclock_forward")
        .when(step.between(*limits.backward), "setclock_backward")
        .when(step == 0, "duplicate_timestamp")
        .when((step < 0) & (F.abs(step) <= limits.out_of_order), "out_of_order")
        .when(step < 0, "nonmonotonic")
        .when(step >= limits.downtime, "downtime_gap")
    )


# fixed values: class of each kind
EVENT_CLASS = {
    "setclock_forward": "clock", "setclock_backward": "clock", "duplicate_timestamp": "order",
    "out_of_order": "order", "nonmonotonic": "other", "downtime_gap": "downtime",
}


def clock_events(df: DataFrame, keys: Sequence[str], limits: ClockLimits = ClockLimits(), ts: str = "ts", row_no: str = "row_no") -> DataFrame:
    """Every irregular step of a file with its kind and class."""
    classes = F.create_map(*[F.lit(x) for pair in EVENT_CLASS.items() for x in pair])
    step = minutes_between(ts, "prev_ts")
    rows = lag_where(df.select(*keys, ts, row_no), keys, [row_no], {ts: "prev_ts"}, classify_step(step, limits).isNotNull(), by=file_block(row_no))
    return rows.withColumn("event_type", classify_step(step, limits)).select(
        *keys, row_no, "prev_ts", ts, F.bround(step, 3).alias("gap_min"), "event_type",
        classes[F.col("event_type")].alias("event_class"),
    )


def clock_summary(df: DataFrame, keys: Sequence[str], limits: ClockLimits = ClockLimits(), year: str = "year", ts: str = "ts", row_no: str = "row_no") -> DataFrame:
    """Counts, first times, repeated sets and a verdict with reasons per file and year."""
    kind = F.col("event_type")
    # each event with the one before it of its class
    ev = lag_where(clock_events(df, keys, limits, ts, row_no), [*keys, "event_class"], [row_no], {"event_type": "_before"}, F.lit(True), by=file_block(row_no))
    same = (F.col("event_class") == "clock") & (F.col("_before") == kind)
    first = {k: F.min_by(ts, F.when(kind == k, F.col(row_no))) for k in ("setclock_forward", "setclock_backward", "out_of_order")}
    counts = ev.groupBy(*keys).agg(
        *[F.count_if(kind == k).alias(n) for k, n in (
            ("setclock_forward", "forward_setclock"), ("setclock_backward", "backward_setclock"),
            ("duplicate_timestamp", "duplicate_timestamps"), ("out_of_order", "out_of_order"), ("downtime_gap", "downtime_gaps"))],
        F.count_if(kind.isin("duplicate_timestamp", "out_of_order", "nonmonotonic")).alias("nonmonotonic_events"),
        first["setclock_forward"].alias("first_forward_time"), first["setclock_backward"].alias("first_backward_time"),
        first["out_of_order"].alias("first_out_of_order_time"),
        F.bool_or(same & (kind == "setclock_forward")).alias("has_FF"),
        F.bool_or(same & (kind == "setclock_backward")).alias("has_BB"),
    )
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    out = rows.join(counts, list(keys), "left")
    numbers = ("forward_setclock", "backward_setclock", "duplicate_timestamps", "out_of_order", "nonmonotonic_events", "downtime_gaps")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in numbers}).withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("has_FF", "has_BB")})
    reasons = F.concat_ws(
        "; ",
        F.when((F.col(year) == 2023) & (F.col("forward_setclock") > 0), "2023 has forward setclock event(s)"),
        F.when(F.col("has_FF"), "consecutive forward setclock events (FF)"),
        F.when(F.col("has_BB"), "consecutive backward setclock events (BB)"),
        F.when(F.col("out_of_order") > 0, F.concat(F.lit("out_of_order events="), F.col("out_of_order").cast("string"))),
    )
    return out.withColumn("reasons", reasons).withColumn(
        "classification", F.when(F.col("reasons") == "", "likely_explained").otherwise("needs_research"))


def implied_mode(offset: Column) -> Column:
    """Clock mode for a running offset in minutes: even hours MDT, odd hours MST."""
    m = F.pmod(offset, F.lit(120))
    return F.when(m == 0, "MDT").when(m == 60, "MST").otherwise(
        F.concat(F.lit("SHIFTED("), offset.cast("string"), F.lit("min)")))


def clock_offset_timeline(df: DataFrame, keys: Sequence[str] = ("logger",), limits: ClockLimits = ClockLimits(), year: str = "year", ts: str = "ts", row_no: str = "row_no") -> DataFrame:
    """Irregular steps of all years with the offset each leaves the clock at.

    Steps are taken inside a file-year in file order, the offset runs across years. A long gap may
    also be a forward set and then gives two rows, the gap before the set.
    """
    per_file = [*keys, year]
    step = minutes_between(ts, "prev_ts")
    enough = df.groupBy(*per_file).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    forward, backward = step.between(*limits.forward), step.between(*limits.backward)

    def event(name: str, delta: int, place: int) -> Column:
        return F.struct(F.lit(name).alias("event_type"), F.lit(delta).alias("normalized_delta_min"), F.lit(place).alias("_place"))

    found = F.filter(F.array(
        F.when(step == 0, event("DUPLICATE", 0, 0)),
        F.when(step >= limits.downtime, event("DOWNTIME", 0, 1)),
        F.when(forward, event("FORWARD_SET_CLOCK", 60, 2)),
        F.when(~forward & backward, event("BACKWARD_SET_CLOCK", -60, 3)),
        F.when((step < 0) & ~forward & ~backward, event("NONMONOTONIC", 0, 4)),
    ), lambda e: e.isNotNull())
    rows = lag_where(df.select(*per_file, ts, row_no), per_file, [row_no], {ts: "prev_ts"}, F.size(found) > 0, by=file_block(row_no))
    # the running sum reads the events twice: they are few beside the rows, and written once
    events = cut_lineage(rows.join(enough, per_file, "left_semi").withColumn("_e", F.explode(found)).select(
        *per_file, row_no, F.col(ts).alias("event_time"), step.alias("gap_min"), "_e.*"))
    block = F.col(year) * F.lit(1_000_000_000).cast("bigint") + F.floor(F.col(row_no) / F.lit(ROW_BLOCK))
    out = running_total(events, keys, [year, row_no, "_place"], F.col("normalized_delta_min").cast("bigint"), "cumulative_offset_min", by=block.cast("bigint"))
    return out.drop("_place").withColumn("implied_mode", implied_mode(F.col("cumulative_offset_min")))


def offset_by_year(timeline: DataFrame, years: DataFrame, keys: Sequence[str] = ("logger",), year: str = "year") -> DataFrame:
    """Offset and mode at the start and end of each file-year, years without sets included.

    `years` lists (key, year); the running sum reads one row per key and year.
    """
    from pyspark.sql import Window

    delta = timeline.groupBy(*keys, year).agg(
        F.sum("normalized_delta_min").alias("_d"), F.count_if(F.col("event_type") == "FORWARD_SET_CLOCK").alias("forward_setclock"),
        F.count_if(F.col("event_type") == "BACKWARD_SET_CLOCK").alias("backward_setclock"))
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    rows = years.select(*keys, year).distinct().join(delta, [*keys, year], "left")
    d = F.coalesce(F.col("_d"), F.lit(0))
    out = rows.withColumn("end_offset_min", F.sum(d).over(w)).withColumn("start_offset_min", F.col("end_offset_min") - d)
    return out.select(
        *keys, year, "start_offset_min", implied_mode(F.col("start_offset_min")).alias("start_mode"), "end_offset_min",
        implied_mode(F.col("end_offset_min")).alias("end_mode"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("forward_setclock", "backward_setclock")])


def jump_events(df: DataFrame, keys: Sequence[str], step: float = 15.0, ts: str = "ts", row_no: str = "row_no") -> DataFrame:
    """Steps that look like a clock set on a regular cadence; series of fewer than 3 rows have none."""
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    s = minutes_between(ts, "prev_ts")
    kind = F.when(s > step + 40, "forward").when(s < -40, "backward")
    rows = lag_where(df.select(*keys, ts, row_no), keys, [row_no], {ts: "prev_ts"}, kind.isNotNull(), by=file_block(row_no))
    return rows.join(enough, list(keys), "left_semi").select(*keys, kind.alias("kind"), "prev_ts", ts, s.alias("gap_min"))


def reference_logger(df: DataFrame, logger: str = "logger", year: str = "year") -> DataFrame:
    """Per year the logger with the most readings, the first name on a tie."""
    n = df.groupBy(year, logger).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(year).agg(F.min_by(logger, F.struct(-F.col("_n"), F.col(logger))).alias("ref_logger"))


def overlap_test(df: DataFrame, reference: DataFrame, transitions: DataFrame, logger: str = "logger", year: str = "year", ts: str = "ts") -> DataFrame:
    """Share of a logger's instants that its year's reference has, as read and with one season moved
    by an hour (standard time back, daylight time forward).

    Three copies of each distinct instant meet the reference's instants by equality.
    """
    spans = transitions.groupBy("year").agg(
        F.min(F.when(F.col("kind") == "gap", F.col("local_end"))).alias("_dst_a"),
        F.min(F.when(F.col("kind") == "fold", F.col("local_start"))).alias("_dst_b"),
    ).withColumnRenamed("year", year)
    points = df.select(year, logger, ts).distinct()
    t = F.col(ts)
    summer = (t >= F.col("_dst_a")) & (t < F.col("_dst_b"))
    moved = F.array(
        F.struct(F.lit("base").alias("v"), t.alias("t")),
        F.struct(F.lit("mst").alias("v"), F.when(summer, t).otherwise(shift(t, -3600)).alias("t")),
        F.struct(F.lit("mdt").alias("v"), F.when(summer, shift(t, 3600)).otherwise(t).alias("t")),
    )
    copies = points.join(spans, year).withColumn("_m", F.explode(moved)).select(year, logger, "_m.v", "_m.t").distinct()
    ref_points = points.join(reference, year).filter(F.col(logger) == F.col("ref_logger")).select(
        year, "ref_logger", F.col(ts).alias("t"), F.lit(1).alias("_hit"))
    hits = copies.join(ref_points.drop("ref_logger"), [year, "t"], "left").groupBy(year, logger).agg(
        *[F.count_if((F.col("v") == v) & F.col("_hit").isNotNull()).alias(f"_{v}") for v in ("base", "mst", "mdt")],
        F.count_if(F.col("v") == "base").alias("_n"))  # one such copy per instant
    out = hits.join(reference, year)
    share = {v: F.col(f"_{v}") / F.col("_n") for v in ("base", "mst", "mdt")}
    return out.select(
        year, logger, "ref_logger", share["base"].alias("base_overlap"), share["mst"].alias("overlap_shift_mst_minus1h"),
        share["mdt"].alias("overlap_shift_mdt_plus1h"), (share["mst"] - share["base"]).alias("delta_mst_minus1h"),
        (share["mdt"] - share["base"]).alias("delta_mdt_plus1h"))


def clock_mode(df: DataFrame, transitions: DataFrame, logger: str = "logger", year: str = "year", ts: str = "ts", row_no: str = "row_no", gain: float = 0.10) -> DataFrame:
    """How a logger's clock was run in a year: manual, seasonal, always one mode, or unknown."""
    keys = [year, logger]
    jumps = jump_events(df, keys, 15.0, ts, row_no)
    kind, gap = F.col("kind"), F.col("gap_min")
    fwd = (kind == "forward") & gap.between(40.0, 120.0)
    bwd = (kind == "backward") & gap.between(-120.0, -40.0)
    counts = jumps.groupBy(*keys).agg(
        F.count_if(fwd).alias("n_forward"), F.count_if(bwd).alias("n_backward"), F.min(F.when(fwd, F.col(ts))).alias("forward_at"))
    spring = transitions.filter("kind = 'gap'").groupBy(F.col("year").alias(year)).agg(F.min("local_end").alias("_dst"))
    overlap = overlap_test(df, reference_logger(df, logger, year), transitions, logger, year, ts)
    out = overlap.join(counts, keys, "left").join(spring, year, "left").withColumns({
        c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_forward", "n_backward")})
    a, b = F.col("delta_mst_minus1h"), F.col("delta_mdt_plus1h")
    n_f, n_b, at, dst = F.col("n_forward"), F.col("n_backward"), F.col("forward_at"), F.col("_dst")
    seasonal = (n_f == 1) & (n_b == 0) & (at >= dst) & (at <= shift(dst, 200 * 86400.0))
    mode = (
        F.when(n_f + n_b >= 3, "irregular_manual").when(F.coalesce(seasonal, F.lit(False)), "seasonal_manual")
        .when((a >= gain) & (a > b), "always_mdt").when((b >= gain) & (b > a), "always_mst").otherwise("unknown")
    )
    return out.withColumn("mode", mode).select(*keys, "ref_logger", "mode", "n_forward", "n_backward", "base_overlap", "delta_mst_minus1h", "delta_mdt_plus1h")
