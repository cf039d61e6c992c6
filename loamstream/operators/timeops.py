"""Clock repair, civil time, year and range filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..fixed_values import CLOCK_STEPS
from ..plans import lag_in_time
from ..plans.slices import floor_to, micros, minutes_between, shift


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def parse_ts(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd HH:mm:ss", to: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Strict parse; returns (good rows with `to`, rejected rows)."""
    parsed = df.withColumn(to, F.try_to_timestamp(F.trim(col), F.lit(fmt)).cast("timestamp_ntz"))
    return parsed.filter(F.col(to).isNotNull()), parsed.filter(F.col(to).isNull()).drop(to)


def parse_ts_formats(
    df: DataFrame, col: str, formats: Sequence[str], by: Sequence[str] = (), to: str = "ts"
) -> DataFrame:
    """Parse with the first format that reads anything in the source, then with the generic reader.

    `by` names the source columns; without it every row picks its own format. The winner per
    source is one aggregated row, joined back (small side, Spark broadcasts it by size).
    """
    text = F.trim(F.col(col))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    generic = text.try_cast("timestamp_ntz")
    if not by:
        return df.withColumn(to, F.coalesce(*tries, generic))
    winner = df.groupBy(*by).agg(
        F.coalesce(*[F.max(F.when(t.isNotNull(), F.lit(i))) for i, t in enumerate(tries)],
                   F.lit(len(tries))).alias("_fmt")
    )
    picked = F.coalesce(*[F.when(F.col("_fmt") == i, t) for i, t in enumerate(tries)],
                        F.when(F.col("_fmt") == len(tries), generic))
    return df.join(winner, list(by), "left").withColumn(to, picked).drop("_fmt")


def correct_clock(
    df: DataFrame,
    steps: Mapping[str, Sequence[tuple[str, int]]] = CLOCK_STEPS,
    tag: Column | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Add minutes from a start time on, step by step on the already shifted time.

    The step list is a map literal keyed by logger, folded inside one expression: no join, no loop.
    """
    tag = tag if tag is not None else F.concat("strip", "location")
    entries = []
    for logger, logger_steps in steps.items():
        entries += [F.lit(logger), F.array(*[
            F.struct(micros(ntz(start)).alias("from"), F.lit(minutes * 60_000_000).cast("bigint").alias("add"))
            for start, minutes in logger_steps
        ])]
    table = F.create_map(*entries)
    moved = F.aggregate(
        F.coalesce(table[tag], F.expr("array_remove(array(named_struct('from', 0L, 'add', 0L)), named_struct('from', 0L, 'add', 0L))")),
        micros(ts),
        lambda t, s: F.when(t >= s["from"], t + s["add"]).otherwise(t),
    )
    return df.withColumn(ts, F.timestamp_micros(moved).cast("timestamp_ntz"))


def to_civil(df: DataFrame, offset: str = "-07:00", zone: str = "America/Denver", ts: str = "ts") -> DataFrame:
    """Fixed-offset clock to civil time; `ts_utc` keeps the instant, which stays unique in autumn."""
    return df.withColumn(
        "ts_utc", F.convert_timezone(F.lit(offset), F.lit("UTC"), F.col(ts)).cast("timestamp")
    ).withColumn("ts_local", F.convert_timezone(F.lit(offset), F.lit(zone), F.col(ts)))


def dst_transitions(years: DataFrame, zone: str = "America/Denver") -> DataFrame:
    """Offset changes of a zone for the years in column `year`.

    Columns: year, at_utc, before_min, after_min (offsets), kind ('gap' or 'fold'), and the local
    interval [local_start, local_end) that is skipped or repeated. Each hour is compared with the
    hour before it by expression, so no ordering is needed.
    """
    hours = years.select("year").distinct().withColumn(
        "at_utc",
        F.explode(F.sequence(
            F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
            F.make_timestamp_ntz("year", F.lit(12), F.lit(31), F.lit(23), F.lit(0), F.lit(0)),
            F.expr("interval 1 hour"),
        )),
    )

    def offset(at: Column) -> Column:
        return minutes_between(F.convert_timezone(F.lit("UTC"), F.lit(zone), at), at).cast("int")

    found = hours.withColumn("before_min", offset(shift("at_utc", -3600))).withColumn(
        "after_min", offset(F.col("at_utc"))
    ).filter("before_min <> after_min")
    by_before = shift("at_utc", F.col("before_min") * 60)
    by_after = shift("at_utc", F.col("after_min") * 60)
    return found.select(
        "year", "at_utc", "before_min", "after_min",
        F.when(F.col("after_min") > F.col("before_min"), "gap").otherwise("fold").alias("kind"),
        F.least(by_before, by_after).alias("local_start"),
        F.greatest(by_before, by_after).alias("local_end"),
    )


def normalize_local(df: DataFrame, transitions: DataFrame, ts: str = "ts") -> DataFrame:
    """Civil time made unambiguous: gap times move to the gap's end, repeated times are dropped."""
    def edge(kind: str, side: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(side))).alias(f"_{kind}_{side[6:]}")

    per_year = transitions.groupBy(F.col("year").alias("_year")).agg(
        edge("gap", "local_start"), edge("gap", "local_end"),
        edge("fold", "local_start"), edge("fold", "local_end"),
    )
    t = F.col(ts)
    joined = df.withColumn("_year", F.year(ts)).join(per_year, "_year", "left")
    in_fold = (t >= F.col("_fold_start")) & (t < F.col("_fold_end"))
    in_gap = (t >= F.col("_gap_start")) & (t < F.col("_gap_end"))
    return (
        joined.filter(~F.coalesce(in_fold, F.lit(False)))
        .withColumn(ts, F.when(in_gap, F.col("_gap_end")).otherwise(t))
        .select(*df.columns)
    )


def year_window(df: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    """Half-open calendar year."""
    return df.filter((F.col(ts) >= ntz(f"{year}-01-01")) & (F.col(ts) < ntz(f"{year + 1}-01-01")))


def range_filter(df: DataFrame, start: str, end: str, ts: str = "ts", last_day: bool = True) -> DataFrame:
    """`[start, end + 1 day)` for queries; `[start, end]` to midnight with `last_day=False`."""
    if last_day:
        upper = F.col(ts) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")
    else:
        upper = F.col(ts) <= ntz(end)
    return df.filter((F.col(ts) >= ntz(start)) & upper)


def pull_window(
    devices: DataFrame, now: datetime | Column, hours: float = 24.0, last_seen: str = "last_seen"
) -> DataFrame:
    """Per device the interval to fetch: the end is now floored to 15 minutes, the start the later
    of the look-back and the last row seen."""
    at = now if isinstance(now, Column) else ntz(now.isoformat(sep=" "))
    end = floor_to(at, 900)
    return devices.withColumn("pull_end", end).withColumn(
        "pull_start", F.greatest(shift(end, -hours * 3600), F.col(last_seen))
    )


def dst_window_audit(
    df: DataFrame, transitions: DataFrame, keys: Sequence[str], hours: int = 3, step_min: float = 15.0,
    ts: str = "ts",
) -> DataFrame:
    """Steps other than the cadence within `hours` of a transition's local time."""
    near = transitions.select(
        F.col("kind"), shift("local_start", -hours * 3600).alias("_from"),
        shift("local_start", hours * 3600).alias("_to"),
    )
    from ..plans import interval_join

    inside = interval_join(df.select(*keys, ts).distinct(), near, [], ts, "_from", "_to", width=6 * 3600)
    lagged = lag_in_time(inside, [*keys, "kind", "_from"], [ts], {ts: "prev_ts"}, width=None)
    step = minutes_between(ts, "prev_ts")
    return lagged.withColumn("step_min", step).filter(F.col("step_min") != step_min).drop("_from", "_to")


def epoch1990(seconds: Column) -> Column:
    """Device seconds since 1990-01-01 to a timestamp."""
    return shift(ntz("1990-01-01"), seconds.cast("double"))
