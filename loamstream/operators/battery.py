"""Battery replacement detection and validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans import last_known_before, latest_before, nearest_join
from ..plans.slices import DAY
from ..session import cut_lineage


def predawn(df: DataFrame, keys: Sequence[str], hour: int = 5, minutes: int = 20, ts: str = "ts", value: str = "value") -> DataFrame:
    """Median voltage and time of the readings around a fixed hour, one row per day.

    A group is a 40-minute window of one day; copies of an instant are reduced first.
    """
    once = df.filter(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.min(value).alias(value))
    of_day = F.hour(ts) * 60 + F.minute(ts)
    near = once.filter(F.abs(of_day - F.lit(hour * 60)) <= minutes)
    mid = F.percentile(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0.5))
    return near.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.timestamp_micros(mid.cast("bigint")).cast("timestamp_ntz").alias("time"),
        F.percentile(value, F.lit(0.5)).alias("value"),
    )


def _islands(days: DataFrame, keys: Sequence[str], floor: float) -> DataFrame:
    """Good days with an id shared by consecutive dates. One row per day, so a key is bounded by time."""
    good = days.filter(F.col("value") >= floor)
    w = Window.partitionBy(*keys).orderBy("date")
    return good.withColumn("_island", F.date_sub("date", F.row_number().over(w)))


def replacement_steps(days: DataFrame, keys: Sequence[str], step: float = 0.6, stable_days: int = 5, floor: float = 12.0) -> DataFrame:
    """Upward steps followed by at least `stable_days` consecutive good days."""
    w = Window.partitionBy(*keys).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(F.col("value") >= floor, F.lit(False))
    rows = days.withColumns({"prev_time": F.lag("time").over(w), "prev_v": F.lag("value").over(w), "_good": good, "_no": F.count_if(good).over(upto)})
    # good days of one island share their date less their number; what is left of it is counted from its end
    rest = Window.partitionBy(*keys, "_good", F.when(F.col("_good"), F.date_sub("date", F.col("_no").cast("int")))).orderBy(F.col("date").desc())
    rows = rows.withColumns({"delta_v": F.col("value") - F.col("prev_v"), "stable_streak_days": F.when(F.col("_good"), F.row_number().over(rest)).otherwise(0)})
    return rows.filter((F.col("delta_v") >= step) & (F.col("stable_streak_days") >= stable_days)).select(
        *keys, "prev_time", "time", "prev_v", F.col("value").alias("v"), "delta_v", "stable_streak_days")


def good_streaks(days: DataFrame, keys: Sequence[str], floor: float = 12.0, min_days: int = 5) -> DataFrame:
    """Runs of consecutive good days."""
    return _islands(days, keys, floor).groupBy(*keys, "_island").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n_days")
    ).filter(F.col("n_days") >= min_days).drop("_island")


def validate_intervals(df: DataFrame, keys: Sequence[str], start: str = "install_date", end: str = "end_date", order: Sequence[str] = (), width: int = 30 * DAY) -> DataFrame:
    """Intervals that begin before the last known end of the earlier ones; none means valid."""
    seen = last_known_before(df, keys, [start, *order], end, "prev_end", width)
    return seen.filter(F.col(start) < F.col("prev_end"))


def active_at(readings: DataFrame, intervals: DataFrame, keys: Sequence[str], take: Sequence[str], ts: str = "ts", start: str = "install_date", end: str = "end_date", order: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Reading with the interval valid at its time, `start <= ts < end`, an open end never expires.

    For intervals that do not overlap (see `validate_intervals`) the last one begun is the only
    candidate, so this is an as-of join, not a range join. The join looks at the intervals twice; few
    beside the readings, they are written once.
    """
    named = cut_lineage(intervals.withColumn("_end", F.col(end)))
    out = latest_before(readings, named, keys, ts, start, [start, "_end", *take], order, width)
    valid = F.col("_end").isNull() | (F.col(ts) < F.col("_end"))
    return out.withColumns({c: F.when(valid, F.col(c)) for c in (*take, start)}).drop("_end")


def match_nearest(manual: DataFrame, candidates: DataFrame, keys: Sequence[str], take: Sequence[str], days: float = 10.0, manual_ts: str = "manual_date", candidate_ts: str = "candidate_time", manual_order: str = "manual_no", width: int = 30 * DAY) -> DataFrame:
    """Each manual entry with the nearest candidate within `days`; the first entry claims it.

    Entries are taken in `manual_order`; a later one whose nearest candidate is taken stays
    unmatched. The claim is an aggregation, so many entries on one candidate combine early.
    """
    cand = candidates.withColumn("_cand", F.col(candidate_ts))
    # the claims and the answer both read the nearest rows, so they are written once
    near = cut_lineage(nearest_join(manual, cand, keys, manual_ts, candidate_ts, ["_cand", *take], days * DAY, width=width))
    claims = near.filter("_cand IS NOT NULL").groupBy(*keys, "_cand").agg(F.min(manual_order).alias(manual_order))
    won = claims.select(*keys, manual_order, F.lit(True).alias("matched_candidate"))
    out = near.join(won, [*keys, manual_order], "left").withColumn("matched_candidate", F.coalesce("matched_candidate", F.lit(False)))
    ok = F.col("matched_candidate")
    return out.select(
        *manual.columns, "matched_candidate", F.when(ok, F.col("distance_s") / F.lit(float(DAY))).alias("match_abs_days"),
        F.when(ok, F.col("_cand")).alias("cand_time"), *[F.when(ok, F.col(c)).alias(f"cand_{c}") for c in take])
