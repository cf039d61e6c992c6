"""Interval, as-of and nearest joins written as equi-joins and windows over time slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .slices import DAY, HOUR, micros, shift, slice_of


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    width: int = 6 * HOUR,
    closed: bool = True,
) -> DataFrame:
    """Points with every interval that holds them: equi-join on (keys, slice), then the exact test.

    Each interval is copied once per slice it touches (length / width + 1 copies); a point lives in
    one slice, so a pair meets once. No side is broadcast by hint; Spark decides on measured size.
    """
    cut = intervals.filter(F.col(start) <= F.col(end))
    spread = cut.withColumn(
        "_slice", F.explode(F.sequence(slice_of(start, width), slice_of(end, width)))
    )
    inside = F.col(ts) >= F.col(start)
    inside = inside & ((F.col(ts) <= F.col(end)) if closed else (F.col(ts) < F.col(end)))
    located = points.withColumn("_slice", slice_of(ts, width))
    pairs = located.join(spread, [*keys, "_slice"], "inner").filter(inside).drop("_slice")
    return pairs


def range_max(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    ts: str,
    value: Column,
    start: str,
    seconds: float,
    name: str,
) -> DataFrame:
    """Each of the (distinct) spans with every `by` that has points in [start, start + seconds], and their largest `value`, never NULL, as `name`.

    Time is cut into blocks as long as a span, so a span ends in the block after the one it starts in. The running
    maxima of a block, from its first point on and from its last point back, are looked up at the span's two ends:
    a span meets two rows of a `by`, however many points lie in it.
    """
    first = slice_of(start, seconds)
    ends = spans.filter(F.col(start).isNotNull()).withColumn("_e", F.explode(F.array(
        F.struct(F.col(start).alias("_t"), first.alias("_slice"), F.lit(True).alias("_on")),
        F.struct(shift(start, seconds).alias("_t"), (first + 1).alias("_slice"), F.lit(False).alias("_on")),
    ))).select(*spans.columns, "_e.*")
    located = points.select(*keys, *by, slice_of(ts, seconds).alias("_slice"), F.col(ts).alias("_t"), value.alias("_v"))
    there = located.select(*keys, *by, "_slice").distinct()
    asked = ends.select(*keys, "_slice", "_t").distinct().join(there, [*keys, "_slice"])
    line = located.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    block = Window.partitionBy(*keys, *by, "_slice")  # points of the asked instant itself count: the frames hold peers
    answers = line.withColumns({
        "_upto": F.max("_v").over(block.orderBy("_t")), "_from": F.max("_v").over(block.orderBy(F.col("_t").desc())),
    }).filter("_asked").drop("_asked", "_v")
    best = F.max(F.when(F.col("_on"), F.col("_from")).otherwise(F.col("_upto")))
    found = ends.join(answers, [*keys, "_slice", "_t"]).groupBy(*spans.columns, *by).agg(best.alias(name))
    return found.filter(F.col(name).isNotNull())


EVEN_ROWS = 1 << 16
_BITS = 20


def _evenly(sides: Sequence[DataFrame], width: int, rows: int) -> list[DataFrame]:
    """The sides with `_slice`, an order-preserving number of (slice of `width`, part): full slices are cut into parts.

    Rows per slice are counted first (one row per slice is kept); a slice with more than `rows` is cut into as many
    equal parts of time, up to 2^20, so that one hot day is spread over tasks like many quiet ones.
    """
    at = slice_of("_t", width).alias("_c")
    counted = [side.select(at) for side in sides]
    every = counted[0]
    for c in counted[1:]:
        every = every.unionByName(c)
    parts = F.ceil(F.log2(F.col("count") / F.lit(rows))).cast("bigint")
    cuts = cut_lineage(every.filter("_c IS NOT NULL").groupBy("_c").count().select("_c", F.least(F.greatest(parts, F.lit(0)), F.lit(_BITS)).alias("_k")))
    span = F.lit(width * 1_000_000)
    piece = F.call_function("div", F.call_function("shiftleft", micros("_t") - F.col("_c") * span, F.col("_k").cast("int")), span)
    number = F.col("_c") * (1 << _BITS) + F.call_function("shiftleft", piece, (F.lit(_BITS) - F.col("_k")).cast("int"))
    return [side.withColumn("_c", at).join(cuts, "_c", "left").withColumn("_slice", number).drop("_c", "_k") for side in sides]


def _carried(marks: DataFrame, level: int = 0) -> DataFrame:
    """(_slice, _before, _after): the last `_last` before and the first `_first` after each slice.

    A window sees 1024 slices; what lies further comes from the same rule on groups of 1024 slices, four levels up.
    """
    group = F.shiftright("_slice", 10)
    w = Window.partitionBy(group)
    near = marks.select(
        "_slice", group.alias("_up"),
        F.last("_last", ignorenulls=True).over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(w.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    if level == 4:
        return near.select("_slice", "_before", "_after")
    above = marks.groupBy(group.alias("_slice")).agg(
        F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("_slice"))).alias("_first"),
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_slice"))).alias("_last"))
    far = _carried(above, level + 1).select(F.col("_slice").alias("_up"), F.col("_before").alias("_b"), F.col("_after").alias("_a"))
    return near.join(far, "_up", "left").select("_slice", F.coalesce("_before", "_b").alias("_before"), F.coalesce("_after", "_a").alias("_after"))


def _merge_order(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_order: Sequence[str],
    take: Sequence[str],
    width: int,
    both: bool,
) -> DataFrame:
    """Left rows with `_prev` (last right row at or before) and, if `both`, `_next` (first after).

    Both sides are laid on one time line per (keys, slice) and scanned once; nothing is paired.
    A slice also receives the last right row before it and the first after it, found on a table
    with one row per (keys, slice). Without keys, slices are cut evenly (`_evenly`) and that table is
    written once and carried in levels, so that no task sees the whole time line.
    """
    right_row = F.struct(
        F.col(right_ts).alias("_ts"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)],
        *[F.col(c) for c in take],
    )
    left_row = F.struct(*[F.col(c) for c in left.columns])
    r = right.filter(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_t"), right_row.alias("_r"))
    l = left.select(*keys, F.col(left_ts).alias("_t"), left_row.alias("_l"))
    if keys:
        r, l = (side.withColumn("_slice", slice_of("_t", width)) for side in (r, l))
    else:
        r, l = _evenly([r, l], width, EVEN_ROWS)
    # copies of one instant carry no information: the lowest tie-break wins before the shuffle
    r = r.groupBy(*keys, "_slice", "_t").agg(F.min("_r").alias("_r"))
    marks = (
        r.groupBy(*keys, "_slice")
        .agg(F.min_by("_r", "_t").alias("_first"), F.max_by("_r", "_t").alias("_last"))
        .unionByName(
            l.select(*keys, "_slice").distinct(), allowMissingColumns=True
        )
        .groupBy(*keys, "_slice")
        .agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"),)
    )
    if keys:
        w = Window.partitionBy(*keys)
        rows_before = w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        rows_after = w.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = marks.select(
            *keys, "_slice",
            F.last("_last", ignorenulls=True).over(rows_before).alias("_before"),
            F.last("_first", ignorenulls=True).over(rows_after).alias("_after"),
        )
    else:
        edges = _carried(cut_lineage(marks.filter("_slice IS NOT NULL")))
    carried = edges.select(
        *keys, "_slice", F.explode(F.array("_before", "_after")).alias("_r")
    ).filter("_r IS NOT NULL")
    line = (
        r.select(*keys, "_slice", "_t", F.lit(0).alias("_side"), "_r")
        .unionByName(carried.select(*keys, "_slice", F.col("_r._ts").alias("_t"), F.lit(0).alias("_side"), "_r"))
        .unionByName(l.select(*keys, "_slice", "_t", F.lit(1).alias("_side"), "_l"), allowMissingColumns=True)
    )
    inside = Window.partitionBy(*keys, "_slice")
    out = line.withColumn(
        "_prev",
        F.last("_r", ignorenulls=True).over(
            inside.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    if both:
        out = out.withColumn(
            "_next",
            F.last("_r", ignorenulls=True).over(
                inside.orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(
                    Window.unboundedPreceding, 0
                )
            ),
        )
    return out.filter("_side = 1")


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    tolerance: float | None = None,
    right_order: Sequence[str] = (),
    width: int = DAY,
) -> DataFrame:
    """Left rows with the right row closest in time; equal distance takes the earlier one.

    Adds `take` and `distance_s`, all NULL where nothing lies within `tolerance` seconds.
    `right_order` breaks ties between right rows of one instant (lowest wins).
    """
    both = _merge_order(left, right, keys, left_ts, right_ts, right_order, take, width, True)
    t = micros("_t")
    back, ahead = t - micros("_prev._ts"), micros("_next._ts") - t
    use_prev = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead))
    out = both.withColumn("_m", F.when(use_prev, F.col("_prev")).otherwise(F.col("_next")))
    out = out.withColumn("distance_s", F.abs(t - micros("_m._ts")) / F.lit(1e6))
    ok = F.col("distance_s") <= F.lit(tolerance) if tolerance is not None else F.lit(True)
    return out.select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns],
        *[F.when(ok, F.col(f"_m.{c}")).alias(c) for c in take],
        F.when(ok, F.col("distance_s")).alias("distance_s"),
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    right_order: Sequence[str] = (),
    width: int = DAY,
) -> DataFrame:
    """Left rows with the last right row at or before them (as-of, backward)."""
    out = _merge_order(left, right, keys, left_ts, right_ts, right_order, take, width, False)
    return out.select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns],
        *[F.col(f"_prev.{c}").alias(c) for c in take],
    )
