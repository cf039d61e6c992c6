"""Custom seasons: month-day windows anchored to the year they end in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SEASONS
from ..functions import div
from ..plans.slices import as_col
from .resample import _is_rain

Periods = Sequence[Mapping[str, str]]

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def normalize_periods(spec: Any) -> list[dict[str, str]]:
    """Mapping, list of mappings or of objects to `code, label, start, end` with MM-DD bounds."""
    def get(item: Any, name: str, default: str | None = None) -> Any:
        if isinstance(item, Mapping):
            return item.get(name, default)
        return getattr(item, name, default)

    items = [(c, s) for c, s in spec.items()] if isinstance(spec, Mapping) else [
        (get(s, "code"), s) for s in spec or []
    ]
    out = []
    for code, item in items:
        out.append({
            "code": str(code),
            "label": get(item, "label") or str(code).replace("_", " "),
            "start": str(get(item, "start"))[-5:],
            "end": str(get(item, "end"))[-5:],
        })
    return out


def period_label(period: Mapping[str, str]) -> str:
    """`Winter: Nov 1–Mar 31`."""
    def day(mmdd: str) -> str:
        month, d = mmdd.split("-")
        return f"{MONTHS[int(month) - 1]} {int(d)}"

    return f"{period['label']}: {day(period['start'])}–{day(period['end'])}"


def _bounds(period: Mapping[str, str], year: Column) -> tuple[Column, Column]:
    (sm, sd), (em, ed) = (tuple(map(int, period[k].split("-"))) for k in ("start", "end"))
    first = year - (1 if sm > em else 0)
    zero = F.lit(0)
    return (
        F.try_make_timestamp_ntz(first, F.lit(sm), F.lit(sd), zero, zero, zero),
        F.try_make_timestamp_ntz(year, F.lit(em), F.lit(ed), F.lit(23), F.lit(59), F.lit(59.999999)),
    )


def assign_season(ts: str | Column, year: int | Column, periods: Periods = SEASONS) -> Column:
    """Code of the first period that holds `ts` for the anchor year, NULL outside all of them."""
    t = as_col(ts)
    anchor = year if isinstance(year, Column) else F.lit(year)
    out = None
    for p in periods:
        start, end = _bounds(p, anchor)
        inside = (t >= start) & (t <= end)
        out = F.when(inside, F.lit(p["code"])) if out is None else out.when(inside, F.lit(p["code"]))
    return out


def season_rows(df: DataFrame, periods: Periods = SEASONS, ts: str = "ts") -> DataFrame:
    """Each row once per period it falls in, with the year the period is anchored to.

    The period list is a literal, so this is a projection, not a range join; periods may overlap.
    """
    t = F.col(ts)
    mmdd = F.month(t) * 100 + F.dayofmonth(t)
    tests = []
    for p in periods:
        start_mmdd, end_mmdd = (int(p[k].replace("-", "")) for k in ("start", "end"))
        wraps = start_mmdd // 100 > end_mmdd // 100
        anchor = F.year(t) + F.when(mmdd >= start_mmdd, 1).otherwise(0) if wraps else F.year(t)
        start, end = _bounds(p, anchor)
        tests.append(F.when((t >= start) & (t <= end), F.struct(
            F.lit(p["code"]).alias("period_code"), anchor.cast("int").alias("season_year"))))
    hits = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return df.withColumn("_p", hits).select(*df.columns, "_p.period_code", "_p.season_year")


def period_rows(years: DataFrame, periods: Periods) -> DataFrame:
    """Period table for every year in column `season_year` (other columns are kept)."""
    entries = []
    for i, p in enumerate(periods):
        start, end = _bounds(p, F.col("season_year"))
        entries.append(F.struct(
            F.lit(i).alias("ord"), F.lit(p["code"]).alias("period_code"),
            F.lit(p["label"]).alias("period_label"), F.to_date(start).alias("period_start"),
            F.to_date(end).alias("period_end"),
        ))
    return years.withColumn("_p", F.explode(F.array(*entries))).select(*years.columns, "_p.*")


def season_summary(
    rows: DataFrame, years: Sequence[int], periods: Periods = SEASONS, keys: Sequence[str] = ("variable",),
    ts: str = "ts", value: str = "value", digits: int = 3, is_sum: Column | None = None,
    clip: bool = False,
) -> DataFrame:
    """Season mean (sum for rain) per series for the asked years; an empty season gives NULL.

    On daily means this is the default path, on 15-minute rows the custom one. `clip` treats rain
    as increments: missing is 0 and negative is 0.
    """
    is_sum = is_sum if is_sum is not None else _is_rain()
    v = F.col(value)
    if clip:
        v = F.when(is_sum, F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))).otherwise(v)
    found = (
        season_rows(rows.withColumn("_rain", is_sum).withColumn("_v", v), periods, ts)
        .filter(F.col("season_year").isin(*years))
        .groupBy("season_year", "period_code", *keys)
        .agg(F.max("_rain").alias("_rain"), F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    )
    series = found.groupBy(*keys).agg(F.max("_rain").alias("_sums")).withColumn(
        "season_year", F.explode(F.array(*[F.lit(int(y)) for y in years]))
    )
    # the sum of a season nobody recorded is unknown on daily rows, and 0 for increments
    filled = found.groupBy("season_year", "period_code").agg(F.lit(True).alias("_any"))
    grid = period_rows(series, periods).join(filled, ["season_year", "period_code"], "left")
    total = F.when(F.lit(clip) | F.col("_any"), F.coalesce(F.col("_s"), F.lit(0.0)))
    out = F.when(F.col("_sums"), total).otherwise(F.col("_s") / F.when(F.col("_n") > 0, F.col("_n")))
    return grid.join(found, ["season_year", "period_code", *keys], "left").select(
        "season_year", "period_code", "period_label", "period_start", "period_end", *keys,
        F.bround(out, digits).alias(value),
    )


def season_stats(
    df: DataFrame, year: int, periods: Periods = SEASONS,
    keys: Sequence[str] = ("strip", "location", "depth", "variable"), ts: str = "ts",
    value: str = "value", digits: int = 4,
) -> DataFrame:
    """min, mean, max, sd per season and series for one anchor year."""
    from .resample import summary_stats

    coded = df.withColumn("period_code", assign_season(ts, year, periods)).filter("period_code IS NOT NULL")
    return summary_stats(coded, ["period_code", *keys], value, digits)


def season_stats_flat(stats: DataFrame) -> DataFrame:
    """Raw and ratio statistics side by side; `kind` holds 'raw' or 'ratio'.

    `strip` is a strip for raw rows and a pair (`S1_S2`) for ratio rows, as in the wide names.
    """
    keys = ("period_code", "variable", "strip", "depth", "location")
    picks = [
        F.max(F.when(F.col("kind") == kind, F.col(m))).alias(f"{kind}_{m}")
        for kind in ("raw", "ratio") for m in ("min", "mean", "max", "std")
    ]
    return stats.groupBy(*keys).agg(*picks)


def season_nested(stats: DataFrame, digits: int = 4) -> DataFrame:
    """One JSON object per period and variable: series name to its four statistics."""
    name = F.concat_ws("_", "strip", "location", "depth", "kind")
    # a period has one entry per series of the trial, a bounded set
    return stats.groupBy("period_code", "variable").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            name.alias("key"), F.struct("min", "mean", "max", "std").alias("value")))))).alias("stats")
    )


def season_rain(daily: DataFrame, years: DataFrame, periods: Periods = SEASONS, ts: str = "ts", rain: str = "precip_in") -> DataFrame:
    """Rain per season, last day included; inches and millimetres, 0 for a season without rows."""
    sums = season_rows(daily, periods, ts).groupBy("season_year", "period_code").agg(F.sum(rain).alias("_s"))
    total = F.coalesce(F.col("_s"), F.lit(0.0))
    return period_rows(years, periods).join(sums, ["season_year", "period_code"], "left").select(
        *years.columns, "period_code", total.alias("precip_in"), (total * 25.4).alias("precip_mm")
    )


def season_irrigation(events: DataFrame, years: DataFrame, periods: Periods = SEASONS, keys: Sequence[str] = ("strip",), start: str = "start", gallons: str = "gallons_strip", year: str | None = "year") -> DataFrame:
    """Irrigation per strip and season by event start: gallons and thousand gallons.

    Only events filed under the asked year count (`year` column), as winter belongs to the year it
    ends in; pass `year=None` to count by date alone.
    """
    usable = events.filter(F.col(gallons).isNotNull() & F.col(start).isNotNull())
    rows = season_rows(usable, periods, start)
    if year is not None:
        rows = rows.filter(F.col(year) == F.col("season_year"))
    sums = rows.groupBy("season_year", "period_code", *keys).agg(F.sum(gallons).alias("_s"))
    total = F.coalesce(F.col("_s"), F.lit(0.0))
    grid = period_rows(years, periods)
    return grid.join(sums, ["season_year", "period_code", *keys], "left").select(
        *years.columns, "period_code", total.alias("irrigation_gal"),
        F.bround(total / 1000.0, 3).alias("irrigation_kgal"),
    )


def season_frame(summary: DataFrame, rain: DataFrame, irrigation: DataFrame, digits: int = 3) -> DataFrame:
    """Season values of one strip with its rain and irrigation, attached by year and period code."""
    out = summary.join(
        rain.select("season_year", "period_code", "precip_in", "precip_mm"), ["season_year", "period_code"], "left"
    ).join(irrigation, ["season_year", "period_code", *[
        c for c in irrigation.columns if c in summary.columns and c not in ("season_year", "period_code")]], "left")
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.bround(c, digits) for c in numbers})


def season_series(summary: DataFrame, keys: Sequence[str], member: str, pairs: Sequence[tuple[str, str]], value: str = "value") -> DataFrame:
    """Season ratio bars: treated over control without a guard, zero denominator gives NULL."""
    from ..plans import pair_values

    sides = pair_values(summary, keys, member, pairs, value)
    return sides.withColumn("ratio", div(F.col("treated_value"), F.col("control_value")))
