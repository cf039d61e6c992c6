"""How sensors respond to irrigation events.

Events carry `event_id, strip, location, start, end, gallons_strip`; readings are long rows. One
interval join feeds every measure: readings from 2 h before a start to 40 h after it. A group is
one (event, depth), bounded by window length and logger cadence because copies of an instant are
reduced first. Events whose id has one row need less of it (`sight_measures`): their look-back window is
joined, their peak is looked up, and a plateau is worked out once for all that share the peak.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import fixed_values as fv
from ..functions import div
from ..plans import column_quantiles, exact_quantiles, interval_join, null_safe_join, range_max
from ..plans.slices import HOUR, floor_to, hours_between, micros, shift
from ..session import cut_lineage
from .derive import CYLINDER_GAL

PLACE = ("strip", "location")


@dataclass(frozen=True)
class EventConfig:
    baseline_hours: float = fv.BASELINE_HOURS
    peak_hours: float = fv.PEAK_HOURS
    min_increase: float = fv.MIN_PEAK_INCREASE
    plateau_hours: float = fv.PLATEAU_HOURS
    points: int = fv.PLATEAU_POINTS
    slope: float = fv.PLATEAU_SLOPE
    run: int = fv.PLATEAU_RUN
    fallback_hours: float = fv.FALLBACK_HOURS


GRID_SECONDS = 900


def on_grid(readings: DataFrame, keys: Sequence[str] = (*PLACE, "depth"), ts: str = "ts", value: str = "value") -> DataFrame:
    """The 15-minute series of each sensor: means per bin, combined before the shuffle.

    An event's window then meets a fixed number of rows per sensor, however dense the raw readings are,
    so what is joined to events grows with the events alone.
    """
    return readings.groupBy(*keys, floor_to(ts, GRID_SECONDS).alias(ts)).agg(F.avg(value).alias(value))


def window_join(events: DataFrame, readings: DataFrame, before_h: float, after_h: float, keys: Sequence[str] = PLACE, ts: str = "ts", start: str = "start", anchor_end: str | None = None, width: int = 6 * HOUR) -> DataFrame:
    """Readings in [start − before, start + after] (or end + after) of each event of their place."""
    windows = events.withColumns({
        "_from": shift(start, -before_h * 3600), "_to": shift(anchor_end or start, after_h * 3600),
    })
    return interval_join(readings, windows, keys, ts, "_from", "_to", width).drop("_from", "_to")


def _on_grid_from(t: Column) -> Column:
    """First instant of the grid at or after `t`."""
    width = F.lit(GRID_SECONDS * 1_000_000)
    return F.timestamp_micros(F.ceil(micros(t) / width).cast("bigint") * width).cast("timestamp_ntz")


def _sights(*times: Column) -> Column:
    """What of the grid lies before and after the times: equal for times that no grid instant tells apart."""
    return F.array(*[f for t in times for f in (floor_to(t, GRID_SECONDS), _on_grid_from(t))])


def _sight_of(cfg: EventConfig) -> Column:
    """The sight of a `start` and the ends of its windows; ends that lie whole bins apart tell the same."""
    hours = (0.0, -cfg.baseline_hours, cfg.peak_hours, cfg.peak_hours + cfg.plateau_hours)
    apart = {round(h * 3_600_000_000) % (GRID_SECONDS * 1_000_000): h for h in reversed(hours)}
    return _sights(*[shift("start", h * 3600) for h in apart.values()])


def alike(spans: DataFrame, sight: Column) -> DataFrame:
    """(event_id, like): of events at one place with the same sight of the grid, the smallest id stands for all.

    Their windows hold the same grid rows, so one of them is analysed; their number is bounded by the grid, however
    many events there are. An id with rows of different places or sights stands for itself, and so do copies of an
    event apart from single ones.
    """
    at = F.struct(*PLACE, sight.alias("sight"))
    per = spans.groupBy("event_id").agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("_c"))
    first = F.min("event_id").over(Window.partitionBy("_a", "_c", ~F.col("_a").eqNullSafe(F.col("_b")), F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("event_id"))))
    return per.select("event_id", first.alias("like"))


def standing(spans: DataFrame, like: DataFrame) -> DataFrame:
    """The spans of events that stand for others or themselves."""
    own = like.filter(F.col("like").eqNullSafe(F.col("event_id"))).select(F.col("event_id").alias("_e"))
    return spans.join(own, F.col("event_id").eqNullSafe(F.col("_e")), "left_semi")


def for_all(measures: DataFrame, like: DataFrame) -> DataFrame:
    """The measures of those that stand for others, as a row of every event."""
    known = measures.withColumnRenamed("event_id", "_e")
    out = like.join(known, F.col("like").eqNullSafe(F.col("_e")))
    return out.select("event_id", *[c for c in measures.columns if c != "event_id"])


def by_sight(events: DataFrame, grid: DataFrame, measure: Callable[[DataFrame], DataFrame], cfg: EventConfig = EventConfig()) -> DataFrame:
    """`measure` of the grid rows around each event, worked out once for the events that see the same rows."""
    spans = events.select("event_id", *PLACE, "start")
    like = alike(spans, _sight_of(cfg))
    joined = window_join(standing(spans, like), grid, cfg.baseline_hours, cfg.peak_hours + cfg.plateau_hours)
    return for_all(measure(joined.select("event_id", "depth", "start", "ts", "value")), like)


def _median(v: Column) -> Column:
    return F.percentile(v, F.lit(0.5))


def baseline(joined: DataFrame, cfg: EventConfig = EventConfig(), keys: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    """Median of the look-back window and the time of its last reading."""
    v = _in_window(F.col("value"), F.col("start"), -cfg.baseline_hours, 0.0)
    return joined.groupBy(*keys).agg(
        _median(v).alias("baseline_vwc"), F.max(F.when(v.isNotNull(), F.col("ts"))).alias("baseline_time")
    )


def _in_window(v: Column, anchor: Column, from_h: float, to_h: float) -> Column:
    t = F.col("ts")
    return F.when((t >= shift(anchor, from_h * 3600)) & (t <= shift(anchor, to_h * 3600)), v)


def peak(joined: DataFrame, cfg: EventConfig = EventConfig(), keys: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    """Highest reading after the start; the first one wins when the maximum repeats."""
    v = _in_window(F.col("value"), F.col("start"), 0.0, cfg.peak_hours)
    first_max = F.when(v.isNotNull(), F.struct(v, -micros("ts")))
    return joined.groupBy(*keys).agg(F.max(v).alias("peak_vwc"), F.max_by("ts", first_max).alias("peak_time"))


def baseline_and_peak(joined: DataFrame, cfg: EventConfig = EventConfig(), keys: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    """Both in one aggregation, with the increase and whether it counts as a peak."""
    low = _in_window(F.col("value"), F.col("start"), -cfg.baseline_hours, 0.0)
    high = _in_window(F.col("value"), F.col("start"), 0.0, cfg.peak_hours)
    first_max = F.when(high.isNotNull(), F.struct(high, -micros("ts")))
    out = joined.groupBy(*keys).agg(
        _median(low).alias("baseline_vwc"), F.max(F.when(low.isNotNull(), F.col("ts"))).alias("baseline_time"),
        F.max(high).alias("peak_vwc"), F.max_by("ts", first_max).alias("peak_time"),
    )
    rise = F.col("peak_vwc") - F.col("baseline_vwc")
    found = F.col("peak_vwc").isNotNull() & (rise.isNull() | (rise >= cfg.min_increase))
    return out.withColumns({"peak_increase": rise, "peak_found": found})


def plateau(joined: DataFrame, peaks: DataFrame, cfg: EventConfig = EventConfig(), keys: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    """Level the series settles on after its peak, and by which rule.

    Smoothed over `points` centred rows, slope per hour by the median step; the first of at least
    `run` flat rows starts the plateau, the median of `points` rows is its level. Otherwise the
    rows from `fallback_hours` on. `plateau_method` tells which, or why there is none.
    """
    known = peaks.select(*keys, "peak_time", "peak_found")
    return _settle(joined.join(known, list(keys)), cfg, keys, ())


def event_measures(joined: DataFrame, cfg: EventConfig = EventConfig(), keys: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    """Baseline, peak and plateau of every (event, depth) in one pass over the joined readings.

    All windows and the last aggregation are clustered by the same keys, so the joined set is
    shuffled once, and nothing is joined back to it.
    """
    whole = Window.partitionBy(*keys)
    low = _in_window(F.col("value"), F.col("start"), -cfg.baseline_hours, 0.0)
    high = _in_window(F.col("value"), F.col("start"), 0.0, cfg.peak_hours)
    rows = joined.withColumns({"_low": low, "_high": high}).withColumns({
        "baseline_vwc": _median(F.col("_low")).over(whole),
        "baseline_time": F.max(F.when(F.col("_low").isNotNull(), F.col("ts"))).over(whole),
        "peak_vwc": F.max("_high").over(whole),
    })
    rows = rows.withColumn("peak_time", F.min(F.when(F.col("_high") == F.col("peak_vwc"), F.col("ts"))).over(whole))
    rise = F.col("peak_vwc") - F.col("baseline_vwc")
    rows = rows.withColumns({
        "peak_increase": rise,
        "peak_found": F.col("peak_vwc").isNotNull() & (rise.isNull() | (rise >= cfg.min_increase)),
    })
    return _settle(rows, cfg, keys, ("baseline_vwc", "baseline_time", "peak_vwc", "peak_time", "peak_increase"))


def _settle(rows: DataFrame, cfg: EventConfig, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Plateau of rows that know their `peak_time` and `peak_found`; `carry` is constant per key."""
    t = F.col("ts")
    later = (t >= F.col("peak_time")) & (t <= shift("peak_time", cfg.plateau_hours * 3600))
    rows = rows.withColumn("_after", F.coalesce(F.col("peak_found") & F.col("value").isNotNull() & later, F.lit(False)))
    # rows after the peak are windowed apart from the others of their key
    whole = Window.partitionBy(*keys, "_after")
    ordered = whole.orderBy("ts")
    half = cfg.points // 2
    rows = rows.withColumns({
        "_rn": F.row_number().over(ordered),
        "_step": (micros("ts") - F.lag(micros("ts")).over(ordered)) / F.lit(3.6e9),
        "_smooth": F.avg("value").over(ordered.rowsBetween(-half, cfg.points - half - 1)),
    })
    rows = rows.withColumns({"_step_h": _median(F.col("_step")).over(whole), "_n": F.count("value").over(whole)})
    slope = (F.col("_smooth") - F.lag("_smooth").over(ordered)) / F.when(F.col("_step_h") > 0, F.col("_step_h"))
    rows = rows.withColumn("_flat", F.coalesce(F.abs(slope) <= cfg.slope, F.lit(False)))
    # rows of one flat run share the number of rows before them that are not flat
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_flat"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run_rows = F.sum(F.col("_flat").cast("int")).over(Window.partitionBy(*keys, "_after", "_run"))
    rows = rows.withColumn("_ok", F.col("_flat") & (run_rows >= cfg.run))
    fall_from = t >= shift("peak_time", cfg.fallback_hours * 3600)
    rows = rows.withColumns({
        "_first": F.min(F.when(F.col("_ok"), F.col("_rn"))).over(whole),
        "_fall": F.min(F.when(fall_from, F.col("_rn"))).over(whole),
    })

    def part(first: str) -> Column:
        return F.col("_after") & F.coalesce((F.col("_rn") >= F.col(first)) & (F.col("_rn") < F.col(first) + cfg.points), F.lit(False))

    def after(c: str) -> Column:
        return F.max(F.when(F.col("_after"), F.col(c))).alias(c)

    # a key's first rows carry its constants, the rest of the rows have done their work
    stats = rows.filter((F.col("_rn") == 1) | part("_first") | part("_fall")).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in (*carry, "peak_found")],
        *[after(c) for c in ("_n", "_step_h", "_first", "_fall")],
        _median(F.when(part("_first"), F.col("value"))).alias("_flat_v"),
        F.min(F.when(part("_first"), t)).alias("_flat_t"),
        _median(F.when(part("_fall"), F.col("value"))).alias("_fall_v"),
        F.min(F.when(part("_fall"), t)).alias("_fall_t"),
    )
    method = (
        F.when(~F.col("peak_found"), "no_peak")
        .when(F.coalesce(F.col("_n"), F.lit(0)) < max(cfg.points, cfg.run), "insufficient_data")
        .when(~F.coalesce(F.col("_step_h") > 0, F.lit(False)), "unknown_step")
        .when(F.col("_first").isNotNull(), "flat_segment")
        .when(F.col("_fall").isNotNull(), "fallback_window").otherwise("fallback_empty")
    )
    named = stats.withColumn("plateau_method", method)

    def choose(kind: str) -> Column:
        m = F.col("plateau_method")
        return F.when(m == "flat_segment", F.col(f"_flat_{kind}")).when(m == "fallback_window", F.col(f"_fall_{kind}"))

    own = (*carry, "peak_found") if carry else ()
    return named.select(*keys, *own, choose("v").alias("plateau_vwc"), choose("t").alias("plateau_time"), "plateau_method")


SIGHT = (*PLACE, "sight")


def sight_measures(events: DataFrame, grid: DataFrame, measure: Callable[..., DataFrame] | None = None, cfg: EventConfig = EventConfig()) -> DataFrame:
    """(strip, location, sight, depth) with what `measure` says of an event of that sight whose id has one row.

    Few rows of the grid meet a sight: those of the look-back window for its baseline, and the two ends of a window
    for its peak and for whether there is anything to see. The plateau hangs on sensor and peak time alone, for the
    rows after a peak lie inside the window of every event that has it, so events that share a peak share its plateau.
    `grid` is read several times.
    """
    measure = measure or event_measures
    keys = (*SIGHT, "depth")
    sights = cut_lineage(events.groupBy(*PLACE, _sight_of(cfg).alias("sight")).agg(F.min("start").alias("start")))
    span = cfg.baseline_hours + cfg.peak_hours + cfg.plateau_hours
    early = sights.withColumn("start", shift("start", -cfg.baseline_hours * 3600))
    parts = [range_max(grid, early, PLACE, ["depth"], "ts", F.lit(True), "start", span * 3600, "_seen").select(*keys)]
    if measure is not peak:
        near = window_join(sights, grid, cfg.baseline_hours, 0.0, width=max(GRID_SECONDS, round(cfg.baseline_hours * HOUR)))
        parts.append(baseline(near, cfg, keys))
    if measure is not baseline:
        # the highest reading, of equal ones the first; a window of missing readings has none
        top = F.struct(F.col("value").alias("v"), (-micros("ts")).alias("t"))
        high = range_max(grid, sights, PLACE, ["depth"], "ts", top, "start", cfg.peak_hours * 3600, "_top").filter("_top.v IS NOT NULL").select(
            *keys, F.col("_top.v").alias("peak_vwc"), F.timestamp_micros(-F.col("_top.t")).cast("timestamp_ntz").alias("peak_time"))
        parts.append(high)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    out = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])
    if measure is not event_measures:
        return out
    rise = F.col("peak_vwc") - F.col("baseline_vwc")
    found = F.col("peak_vwc").isNotNull() & (rise.isNull() | (rise >= cfg.min_increase))
    depth = F.array("depth").alias("_depth")  # in an array, missing depths are equal
    out = out.select("*", rise.alias("peak_increase"), found.alias("peak_found"), depth)
    sensor = (*PLACE, "_depth", "peak_time")
    peaks = high.select(*PLACE, depth, "peak_time").distinct().withColumn("_until", shift("peak_time", cfg.plateau_hours * 3600))
    series = grid.select(*PLACE, depth, "ts", "value")
    later = interval_join(series, peaks, [*PLACE, "_depth"], "ts", "peak_time", "_until").drop("_until").withColumn("peak_found", F.lit(True))
    settled = _settle(later, cfg, sensor, ()).withColumn("peak_found", F.lit(True))
    out = out.join(settled, [*sensor, "peak_found"], "left")
    return out.select(*keys, "baseline_vwc", "baseline_time", "peak_vwc", "peak_time", "peak_increase", "peak_found", "plateau_vwc", "plateau_time",
                      F.coalesce("plateau_method", F.lit("no_peak")).alias("plateau_method"))


def _rows_of_id(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Events whose id has one row, and the others, if there are any (ids are counted at once)."""
    most = events.groupBy("event_id").count().agg(F.max("count")).first()[0]
    if (most or 0) < 2:
        return events, None
    counted = events.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    return counted.filter("_c = 1").drop("_c"), counted.filter("_c > 1").drop("_c")


def measured_events(events: DataFrame, grid: DataFrame, measure: Callable[..., DataFrame] | None = None, cfg: EventConfig = EventConfig()) -> DataFrame:
    """`measure` of every (event, depth): looked up by sight; ids with several rows are analysed on the rows of all of them."""
    measure = measure or event_measures
    spans = events.select("event_id", *PLACE, "start")
    one, several = _rows_of_id(spans)
    grid = cut_lineage(grid)
    known = sight_measures(one, grid, measure, cfg)
    out = one.withColumn("sight", _sight_of(cfg)).join(known, list(SIGHT)).drop(*SIGHT, "start")
    return out if several is None else out.unionByName(by_sight(several, grid, lambda joined: measure(joined, cfg), cfg))


def analyze_events(readings: DataFrame, events: DataFrame, depths: Sequence[str] = fv.DEPTHS, cfg: EventConfig = EventConfig(), variable: str = "VWC") -> DataFrame:
    """One row per event and depth: baseline, peak, plateau, timing, duration and flow."""
    keys = ("event_id", "depth")
    vwc = cut_lineage(on_grid(readings.filter((F.col("variable") == variable) & F.col("depth").isin(*depths) & F.col("value").isNotNull())))
    one, several = _rows_of_id(events)
    known = sight_measures(one, vwc, cfg=cfg)
    names = [c for c in known.columns if c not in (*SIGHT, "depth")]
    # all depths of a sight travel in one row, so events are spread over depths after the join
    packed = known.groupBy(*SIGHT).agg(F.map_from_entries(F.collect_list(F.struct("depth", F.struct(*names)))).alias("_m"))
    rest = [c for c in events.columns if c != "event_id"]
    at_depths = F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")
    found = F.when(F.col("event_id").isNotNull(), F.element_at("_m", F.col("depth")))
    out = one.withColumn("sight", _sight_of(cfg)).join(packed, list(SIGHT), "left").select("event_id", at_depths, *rest, "_m")
    out = out.withColumn("_m", found).select("event_id", "depth", *rest, *[F.col(f"_m.{c}").alias(c) for c in names])
    if several is not None:
        measures = by_sight(several, vwc, lambda joined: event_measures(joined, cfg, keys), cfg)
        out = out.unionByName(several.withColumn("depth", at_depths).join(measures, list(keys), "left").select(*out.columns))
    hours = hours_between("end", "start")
    return out.withColumns({
        "peak_found": F.coalesce("peak_found", F.lit(False)),
        "plateau_method": F.coalesce("plateau_method", F.lit("no_peak")),
        "time_to_peak_hours": hours_between("peak_time", "start"),
        "time_to_plateau_hours": hours_between("plateau_time", "start"),
        "event_duration_hours": hours,
        "avg_flow_gph_strip": F.when(hours > 0, F.col("gallons_strip") / hours),
        "sensor_col": F.concat(F.lit(f"{variable}_"), "depth", F.lit("_raw_"), "strip", F.lit("_"), "location"),
    })


def storage_at(results: DataFrame, readings: DataFrame) -> DataFrame:
    """Water stored in the profile exactly at the baseline and plateau instants.

    Sums the cylinder volume of every depth read at that very instant; the join is on
    (strip, location, instant), so a hot logger spreads over its instants.
    """
    vwc = on_grid(readings.filter("variable = 'VWC' AND value IS NOT NULL")).select(
        *PLACE, "ts", (F.col("value") / 100.0 * F.lit(CYLINDER_GAL)).alias("gal")
    )
    sums = vwc.groupBy(*PLACE, "ts").agg(F.sum("gal").alias("gal"))
    out, same = results, Window.partitionBy("event_id", "depth")
    for which in ("baseline", "plateau"):
        at = sums.withColumnsRenamed({"ts": f"{which}_time", "gal": f"_{which}_gal"})
        out = out.join(at, [*PLACE, f"{which}_time"], "left")
    known = F.col("event_id").isNotNull() & F.col("depth").isNotNull()
    out = out.select(*results.columns, *[
        F.when(known, F.max(f"_{w}_gal").over(same)).alias(f"profile_{w}_storage_gal") for w in ("baseline", "plateau")])
    out = out.withColumn("event_storage_gal", F.col("profile_plateau_storage_gal") - F.col("profile_baseline_storage_gal"))
    usable = F.col("gallons_strip") > 0
    return out.withColumns({
        "efficiency_strip": F.when(usable, F.col("event_storage_gal") / F.col("gallons_strip")),
        "estimated_loss_gal_strip": F.when(usable, F.col("gallons_strip") - F.col("event_storage_gal")),
    })


def profile_storage(results: DataFrame, area_ft2: float, layer_in: float = 6.0, keys: Sequence[str] = ("event_id", "strip", "location", "start", "end")) -> DataFrame:
    """Layer and profile storage in inches and gallons, efficiency and loss, depths used.

    Sums over depths are 0 where every depth is missing; the depth count tells. NULL keys join.
    """
    rows = results.withColumns({
        "baseline_storage_in_layer": F.col("baseline_vwc") / 100.0 * F.lit(layer_in),
        "plateau_storage_in_layer": F.col("plateau_vwc") / 100.0 * F.lit(layer_in),
    }).withColumn("event_storage_in_layer", F.col("plateau_storage_in_layer") - F.col("baseline_storage_in_layer"))
    gal = F.lit(area_ft2 / 12.0 * fv.GALLONS_PER_FT3_PROFILE)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    profile = rows.groupBy(*keys).agg(
        total("baseline_storage_in_layer").alias("profile_baseline_storage_in"),
        total("plateau_storage_in_layer").alias("profile_plateau_storage_in"),
        total("event_storage_in_layer").alias("event_storage_in"),
        F.count("event_storage_in_layer").alias("n_profile_depths_used"),
        F.max("gallons_strip").alias("_g"),
    ).withColumns({
        "profile_area_sqft": F.lit(float(area_ft2)),
        "profile_baseline_storage_gal": F.col("profile_baseline_storage_in") * gal,
        "profile_plateau_storage_gal": F.col("profile_plateau_storage_in") * gal,
        "event_storage_gal": F.col("event_storage_in") * gal,
    }).withColumns({
        "efficiency_strip": F.when(F.col("_g") > 0, F.col("event_storage_gal") / F.col("_g")),
        "estimated_loss_gal_strip": F.col("_g") - F.col("event_storage_gal"),
    }).drop("_g")
    fresh = [c for c in profile.columns if c not in keys]
    return null_safe_join(rows.drop(*fresh), profile, keys, "left")


def derive_event_fields(results: DataFrame, inches: dict[str, int] = fv.DEPTH_INCHES) -> DataFrame:
    """Depth in inches, response delay, lag after shut-off, flow."""
    table = F.create_map(*[F.lit(x) for pair in inches.items() for x in pair])
    hours = F.col("event_duration_hours")
    return results.withColumns({
        "depth_inches": table[F.col("depth")],
        "bottom_response_delay_hr": F.col("time_to_peak_hours"),
        "lag_after_irrigation_hr": F.col("time_to_plateau_hours") - hours,
        "avg_flow_gph_strip": F.when(hours > 0, F.col("gallons_strip") / hours),
    })


def attach_meta(results: DataFrame, events: DataFrame, add: Sequence[str] = ("strip_group",)) -> DataFrame:
    """Event metadata by id, and by (start, end) where the id finds none.

    Several events of one interval would fan rows out, so the smallest metadata row is taken.
    """
    def picked(keys: Sequence[str], prefix: str) -> DataFrame:
        row = F.min(F.struct(*add)).alias("_m")
        return events.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in add])

    by_id = picked(["event_id"], "_i_").filter("trim(cast(event_id AS string)) <> ''")
    by_span = picked(["start", "end"], "_s_")
    out = results.drop(*add).join(by_id, "event_id", "left").join(by_span, ["start", "end"], "left")
    return out.withColumns({
        c: F.coalesce(F.nullif(F.trim(f"_i_{c}"), F.lit("")), F.col(f"_s_{c}")) for c in add
    }).drop(*[f"{p}{c}" for p in ("_i_", "_s_") for c in add])


def statistical_target(results: DataFrame, by: Sequence[str], value: str = "plateau_vwc", k: float = fv.TARGET_K, min_events: int = fv.TARGET_MIN_EVENTS, cap: float = fv.TARGET_CAP) -> DataFrame:
    """min(mean + k sd, cap quantile) per group; the sd of a single event is 0."""
    usable = results.filter(F.col(value).isNotNull())
    base = usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("mean_value"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd_value"),
    )
    caps = exact_quantiles(usable, by, value, {"quantile_cap": cap})
    out = null_safe_join(base, caps, by)
    raw = F.col("mean_value") + F.lit(k) * F.col("sd_value")
    return out.withColumns({
        "raw_target_value": raw, "target_value": F.least(raw, F.col("quantile_cap")),
        "target_is_trustworthy": F.col("n_events") >= min_events,
    })


def recommend_runtime(results: DataFrame, by: Sequence[str], stat: str = "median", value: str = "time_to_plateau_hours", min_events: int = 3) -> DataFrame:
    """Run time to aim for: median, mean or 75th percentile of the time to plateau."""
    usable = results.filter(F.col(value).isNotNull())
    counts = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("_mean"))
    if stat == "mean":
        out = counts.withColumn("runtime_hours", F.col("_mean"))
    elif stat in ("median", "p75"):
        prob = {"median": 0.5, "p75": 0.75}[stat]
        out = null_safe_join(counts, exact_quantiles(usable, by, value, {"runtime_hours": prob}), by)
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    return out.drop("_mean").withColumns({
        "runtime_minutes": F.col("runtime_hours") * 60.0,
        "runtime_is_trustworthy": F.col("n_events") >= min_events,
    })


def target_runtime_summary(results: DataFrame, by: Sequence[str] = ("strip", "sensor_col", "depth", "depth_inches"), min_events: int = 3, k: float = fv.TARGET_K, digits: int = 6) -> DataFrame:
    """Target and run time per sensor (outer), with median duration, lag and flow.

    All quantiles of all columns come from one stacked pass, counts and means from one aggregation.
    """
    target, runtime = "plateau_vwc", "time_to_plateau_hours"
    names = {
        "event_duration_hours": "median_irrigation_duration_hours",
        "lag_after_irrigation_hr": "median_lag_after_irrigation_hr",
        "avg_flow_gph_strip": "median_avg_flow_gph_strip",
    }
    q = column_quantiles(results, by, [target, runtime, *names], {"q": 0.5, "cap": fv.TARGET_CAP})
    # every sensor that has a target or a run time
    base = results.groupBy(*by).agg(
        F.count(target).alias("_nt"), F.avg(target).alias("_mean"), F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("_sd"),
        F.count(runtime).alias("_nr")).filter("_nt > 0 OR _nr > 0")
    nt, nr = F.nullif("_nt", F.lit(0)), F.nullif("_nr", F.lit(0))
    out = null_safe_join(base, q, by).select(
        *by, *[F.col(f"q_{a}").alias(b) for a, b in names.items()],
        nt.alias("n_events_target"), F.when(nt.isNotNull(), F.least(F.col("_mean") + F.lit(k) * F.col("_sd"), F.col(f"cap_{target}"))).alias("target_vwc"),
        (nt >= min_events).alias("target_is_trustworthy"),
        nr.alias("n_events_runtime"), F.col(f"q_{runtime}").alias("runtime_hours"), (F.col(f"q_{runtime}") * 60.0).alias("runtime_minutes"),
        (nr >= min_events).alias("runtime_is_trustworthy"))
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def runtime_table(results: DataFrame, by: Sequence[str] = ("strip", "depth_inches"), min_events: int = 3, digits: int = 6) -> DataFrame:
    """Recommended against actual run time; groups without a plateau are left out."""
    cols = ["time_to_plateau_hours", "event_duration_hours", "avg_flow_gph_strip", "lag_after_irrigation_hr"]
    q = column_quantiles(results, by, cols, {"q": 0.5})
    n = results.groupBy(*by).agg(F.count("time_to_plateau_hours").alias("n_events")).filter("n_events > 0")
    out = null_safe_join(n, q, by)
    return out.select(
        *by, "n_events",
        F.bround("q_time_to_plateau_hours", digits).alias("rec_runtime_hours"),
        F.bround(F.col("q_time_to_plateau_hours") * 60.0, digits).alias("rec_runtime_minutes"),
        (F.col("n_events") >= min_events).alias("rec_runtime_is_trustworthy"),
        F.bround("q_event_duration_hours", digits).alias("actual_runtime_hours"),
        F.bround(F.col("q_event_duration_hours") * 60.0, digits).alias("actual_runtime_minutes"),
        F.bround("q_avg_flow_gph_strip", digits).alias("median_avg_flow_gph_strip"),
        F.bround("q_lag_after_irrigation_hr", digits).alias("median_lag_after_irrigation_hr"),
    )


BATTERY_FIELDS = ("min_v", "median_v", "max_v", "low_count", "high_count", "out_of_range_count", "out_of_range_fraction")


def _bins(readings: DataFrame, keys: Sequence[str], ok: tuple[float, float]) -> DataFrame:
    """15-minute bins with mean, extremes and counts, so that a short brown-out inside a bin is not averaged away."""
    v = F.col("value")
    return readings.groupBy(*keys, floor_to("ts", GRID_SECONDS).alias("ts")).agg(
        F.avg(v).alias("value"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"),
        F.count_if(v < ok[0]).alias("_low"), F.count_if(v > ok[1]).alias("_high"))


def _battery_stats(on: Column, prefix: str) -> list[Column]:
    """Aggregates of the bins for which `on` holds."""
    take = lambda c: F.when(on, F.col(c))
    out_of = take("_low") + take("_high")
    return [
        F.min(take("_lo")).alias(f"{prefix}min_v"), _median(take("value")).alias(f"{prefix}median_v"), F.max(take("_hi")).alias(f"{prefix}max_v"),
        F.sum(take("_low")).alias(f"{prefix}low_count"), F.sum(take("_high")).alias(f"{prefix}high_count"), F.sum(out_of).alias(f"{prefix}out_of_range_count"),
        (F.sum(out_of) / F.sum(take("_n"))).alias(f"{prefix}out_of_range_fraction")]


def _battery_flags(prefix: str) -> dict[str, Column]:
    return {f"flag_{prefix}{name}": F.coalesce(F.col(f"{prefix}{name}_count") > 0, F.lit(False)) for name in ("low", "out_of_range")}


def battery_window(readings: DataFrame, windows: DataFrame, keys: Sequence[str] = ("event_id",), start: str = "start", end: str = "end", ok: tuple[float, float] = fv.BATTERY_OK, prefix: str = "battery_") -> DataFrame:
    """Battery voltage of the event's logger in [start, end]: range, counts outside, flags.

    Windows without voltage keep NULL numbers and false flags. Extremes and counts are those of the readings.
    """
    volts = _bins(readings.filter("variable = 'BattV_Min' AND value IS NOT NULL"), PLACE, ok)
    spans = windows.select(*keys, *PLACE, F.col(start).alias("_a"), F.col(end).alias("_b"))
    stats = interval_join(volts, spans, PLACE, "ts", "_a", "_b").groupBy(*keys).agg(*_battery_stats(F.lit(True), prefix))
    out = windows.select(*keys).distinct().join(stats, list(keys), "left")
    return out.withColumns(_battery_flags(prefix))


def pre_start_flags(readings: DataFrame, rain: DataFrame, results: DataFrame, lookback_h: float = fv.PRE_START_HOURS, min_increase: float = fv.MIN_PEAK_INCREASE, min_rain: float = fv.MIN_RAIN_IN, ok: tuple[float, float] = fv.BATTERY_OK, digits: int = 4) -> DataFrame:
    """Did the sensor react before the water came, and is there an excuse?

    `readings` may hold NULL values (they make the missing fraction), `rain` has `ts, precip_in`,
    `results` one row per event and depth. Sensors with fewer than two readings in the look-back
    window are left out.

    Water content of all depths and battery voltage meet an event's window in one interval join; one aggregation per
    (event, sensor) answers for both, and the battery's row is spread over the event's sensors. Rain has no place: it
    meets the distinct starts.
    """
    spans = results.groupBy("event_id", *PLACE, "start", "end").agg(F.collect_set("depth").alias("_depths")).withColumns({
        "window_start": shift("start", -lookback_h * 3600), "_end": F.coalesce("end", "start")}).withColumn("_stop", F.greatest("_end", "start"))
    wet, volt = F.col("variable") == "VWC", F.col("variable") == "BattV_Min"
    series = _bins(readings.filter(wet | (volt & F.col("value").isNotNull())).withColumn("_depth", F.when(wet, F.col("depth"))), [*PLACE, "variable", "_depth"], ok)
    seen = interval_join(series, spans, PLACE, "ts", "window_start", "_stop")
    before, during = F.col("ts") <= F.col("start"), (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("_end"))
    seen = seen.filter(volt | (wet & before & F.array_contains("_depths", F.col("_depth"))))
    v = F.when(wet, F.col("value"))
    t = F.when(v.isNotNull(), F.col("ts"))
    constant = [F.first(c).alias(c) for c in (*PLACE, "start", "end", "window_start")]
    stats = seen.groupBy("event_id", F.col("_depth").alias("depth")).agg(
        *constant, F.min_by("value", t).alias("first_vwc"), F.max_by("value", t).alias("last_pre_start_vwc"),
        F.max(v).alias("max_pre_start_vwc"), F.max_by("ts", F.when(v.isNotNull(), F.struct(v, -micros("ts")))).alias("max_pre_start_time"),
        F.avg(F.when(wet, v.isNull().cast("double"))).alias("vwc_missing_fraction_pre_start_window"), F.count(v).alias("_wet"),
        *_battery_stats(volt & before, "battery_pre_start_"), *_battery_stats(volt & during, "battery_event_"))
    # one row of an event is its battery's, with NULL depth
    event = Window.partitionBy("event_id")
    fields = [f"{p}{f}" for p in ("battery_pre_start_", "battery_event_") for f in BATTERY_FIELDS]
    stats = stats.withColumns({f: F.max(F.when(F.col("depth").isNull(), F.col(f))).over(event) for f in fields}).filter("depth IS NOT NULL AND _wet >= 2").drop("_wet")
    stats = stats.withColumns({**_battery_flags("battery_pre_start_"), **_battery_flags("battery_event_")})

    starts = results.select("start").distinct().withColumn("window_start", shift("start", -lookback_h * 3600))
    fallen = rain.groupBy(floor_to("ts", GRID_SECONDS).alias("ts")).agg(F.sum("precip_in").alias("precip_in"))
    falls = F.when(F.col("precip_in") > 0, F.col("ts"))
    zero = F.lit(0.0)
    rain_sums = interval_join(fallen, starts, [], "ts", "window_start", "start").groupBy("start").agg(
        F.sum(F.coalesce("precip_in", zero)).alias("total_precip_in_pre_start_window"),
        F.max(F.coalesce("precip_in", zero)).alias("max_precip_in_pre_start_window"),
        F.min(falls).alias("first_precip_time_pre_start_window"), F.max(falls).alias("last_precip_time_pre_start_window"),
    )
    out = stats.join(rain_sums, "start", "left").withColumns({
        "total_precip_in_pre_start_window": F.coalesce("total_precip_in_pre_start_window", zero),
        "max_precip_in_pre_start_window": F.coalesce("max_precip_in_pre_start_window", zero),
        "pre_start_increase": F.col("max_pre_start_vwc") - F.col("first_vwc"),
        "last_minus_first": F.col("last_pre_start_vwc") - F.col("first_vwc"),
    })
    responded = F.col("pre_start_increase") >= min_increase
    rained = F.col("total_precip_in_pre_start_window") >= min_rain
    suspect = (
        F.col("flag_battery_pre_start_out_of_range") | F.col("flag_battery_event_out_of_range")
        | (F.col("vwc_missing_fraction_pre_start_window") > 0.25)
    )
    out = out.withColumns({
        "flag_pre_start_response": responded,
        "likely_precip_driven_pre_start_response": responded & rained,
        "possible_battery_or_logger_issue": suspect,
        "flag_unexplained_pre_start_response": responded & ~rained & ~suspect,
    })
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def event_trust(readings: DataFrame, rain: DataFrame, results: DataFrame, min_delay: float = fv.MIN_RESPONSE_DELAY_HOURS) -> DataFrame:
    """Pre-start flags of every analysed sensor with its measured response delay, volume and duration, and the verdict."""
    measured = results.select("event_id", "depth", "bottom_response_delay_hr", "gallons_strip", "event_duration_hours")
    return classify_trust(pre_start_flags(readings, rain, results).join(measured, ["event_id", "depth"]), min_delay)


def classify_trust(flags: DataFrame, min_delay: float = fv.MIN_RESPONSE_DELAY_HOURS) -> DataFrame:
    """Trust verdict with every reason against it, joined by `; ` in fixed order."""
    delay = F.col("bottom_response_delay_hr")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("flag_unexplained_pre_start_response"), "unexplained_pre_start_response"),
        F.when(F.col("possible_battery_or_logger_issue"), "possible_battery_or_logger_issue"),
        F.when(delay.isNull(), "missing_bottom_response_delay").when(delay < min_delay, "bottom_response_too_early"),
        F.when(F.col("gallons_strip").isNull(), "missing_gallons_strip"),
        F.when(F.col("event_duration_hours").isNull(), "missing_event_duration_hours"),
    )
    return flags.withColumn("_r", reasons).withColumns({
        "trustworthy_event": F.col("_r") == "",
        "trustworthy_reason": F.when(F.col("_r") == "", "ok").otherwise(F.col("_r")),
        "trustworthy_min_bottom_response_delay_hr": F.lit(float(min_delay)),
    }).drop("_r")


CAPACITY_MEASURES = (
    "bottom_response_delay_hr", "time_to_peak_hours", "time_to_plateau_hours", "event_duration_hours",
    "gallons_strip", "baseline_vwc", "peak_vwc", "peak_increase", "plateau_vwc",
    "profile_baseline_storage_gal", "profile_plateau_storage_gal", "event_storage_gal",
    "efficiency_strip", "estimated_loss_gal_strip",
)


def trusted_rows(results: DataFrame, trust: DataFrame, on: Sequence[str] = ("event_id", "depth")) -> DataFrame:
    return results.join(trust.filter("trustworthy_event").select(*on), list(on), "left_semi")


def holding_capacity(results: DataFrame, trust: DataFrame, area_ft2: float, by: Sequence[str] = ("strip_group", "location", "strip", "sensor_col", "depth_inches"), on: Sequence[str] = ("event_id", "depth"), digits: int = 4) -> DataFrame:
    """Mean and sd of every measure over trusted rows, with the storage means in inches.

    Distinct events are counted by a two-step aggregation Spark plans itself.
    """
    gal_per_in = area_ft2 / 12.0 * fv.GALLONS_PER_FT3_PROFILE
    aggs = [F.countDistinct("event_id").alias("n_trustworthy_events")]
    for m in CAPACITY_MEASURES:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"sd_{m}")]
    out = trusted_rows(results, trust, on).groupBy(*by).agg(*aggs).withColumns({
        "profile_area_sqft": F.lit(float(area_ft2)), "gallons_per_profile_inch": F.lit(gal_per_in),
    })
    for m in ("profile_baseline_storage", "profile_plateau_storage", "event_storage"):
        out = out.withColumn(f"mean_{m}_in", F.col(f"mean_{m}_gal") / F.lit(gal_per_in))
        out = out.withColumn(f"mean_{m}_gal_scaled", F.col(f"mean_{m}_in") * F.lit(gal_per_in))
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def water_balance(results: DataFrame, trust: DataFrame, by: Sequence[str] = ("strip_group", "location", "strip", "event_id", "start", "end"), on: Sequence[str] = ("event_id", "depth"), digits: int = 4) -> DataFrame:
    """Per event, means over trusted depths, surplus water and its share."""
    measures = (
        "gallons_strip", "event_storage_gal", "event_storage_in", "profile_area_sqft", "bottom_response_delay_hr",
        "time_to_peak_hours", "time_to_plateau_hours", "event_duration_hours",
    )
    out = trusted_rows(results, trust, on).groupBy(*by).agg(
        F.countDistinct("sensor_col").alias("n_trustworthy_depths"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    surplus = F.col("mean_gallons_strip") - F.col("mean_event_storage_gal")
    out = out.withColumns({
        "estimated_surplus_gal_strip": surplus,
        "estimated_surplus_fraction": F.when(F.col("mean_gallons_strip") > 0, surplus / F.col("mean_gallons_strip")),
    })
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def scaled_storage(results: DataFrame, area_ft2: float, digits: int = 4) -> DataFrame:
    """Storage from one depth's water content over its whole depth, scaled to the profile area."""
    gal = F.lit(area_ft2 / 12.0 * fv.GALLONS_PER_FT3_PROFILE)
    depth = F.col("depth_inches").cast("double")
    out = results.withColumns({
        "gallons_per_profile_inch": gal,
        "profile_baseline_storage_in": F.col("baseline_vwc") / 100.0 * depth,
        "profile_plateau_storage_in": F.col("plateau_vwc") / 100.0 * depth,
    }).withColumn("event_storage_in", F.col("profile_plateau_storage_in") - F.col("profile_baseline_storage_in"))
    out = out.withColumns({
        f"{m}_gal_scaled": F.col(f"{m}_in") * gal
        for m in ("profile_baseline_storage", "profile_plateau_storage", "event_storage")
    })
    surplus = F.col("gallons_strip") - F.col("event_storage_gal_scaled")
    out = out.withColumns({
        "estimated_surplus_gal_strip": surplus,
        "estimated_surplus_fraction": F.when(F.col("gallons_strip") > 0, div(surplus, F.col("gallons_strip"))),
    })
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def column_lineage(tables: dict[str, DataFrame], definitions: DataFrame) -> DataFrame:
    """Every column of every output table with its definition, NULL where none is written.

    Only schemas are read; `definitions` has `variable_name, definition`.
    """
    spark = definitions.sparkSession
    rows = [(name, i, c) for name, df in tables.items() for i, c in enumerate(df.columns)]
    have = spark.createDataFrame(rows, "source_table string, position int, variable_name string")
    return have.join(definitions, "variable_name", "left").select("source_table", "variable_name", "position", *[
        c for c in definitions.columns if c != "variable_name"])
