"""Sentinels, scales, bounds and weather cleaning on long readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BOUNDS, SENTINEL
from ..functions import bounded, converted, nan_to_null, to_celsius, to_fahrenheit
from ..plans import keep_latest, running_total, top_rows


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("source_rank", "row_no")) -> DataFrame:
    """Keep the row with the highest source priority, then the last in file order."""
    return keep_latest(df, keys, order)


def mask_sentinels(df: DataFrame, threshold: float = SENTINEL, value: str = "value") -> DataFrame:
    c = nan_to_null(F.col(value))
    return df.withColumn(value, F.when(F.abs(c) < F.lit(threshold), c))


def scale_units(df: DataFrame, value: str = "value") -> DataFrame:
    """Water content fraction to percent, soil temperature to Fahrenheit."""
    c, v = F.col(value), F.col("variable")
    return df.withColumn(
        value, F.when(v == "VWC", c * F.lit(100.0)).when(v == "T", to_fahrenheit(c)).otherwise(c)
    )


Rules = Mapping[str, tuple[float | None, float | None]]


def _rule(rules: Rules, key: str, side: int) -> Column:
    entries = [x for k, r in rules.items() for x in (F.lit(k), F.lit(r[side]).cast("double"))]
    return F.create_map(*entries)[F.col(key)]


def violations(
    df: DataFrame, rules: Rules = BOUNDS, key: str = "variable", value: str = "value",
    inclusive: bool = True,
) -> DataFrame:
    """Readings with `low`, `high` and `violation`; a rule is a map lookup, not a join."""
    low, high = _rule(rules, key, 0), _rule(rules, key, 1)
    return df.withColumn("low", low).withColumn("high", high).withColumn(
        "violation", bounded(F.col(value), F.col("low"), F.col("high"), inclusive)
    )


def enforce_bounds(
    df: DataFrame, rules: Rules = BOUNDS, key: str = "variable", value: str = "value",
    inclusive: bool = True,
) -> DataFrame:
    """Values outside their bounds become NULL."""
    flagged = violations(df, rules, key, value, inclusive)
    return flagged.withColumn(value, F.when(~F.col("violation"), F.col(value))).select(*df.columns)


def bounds_report(
    df: DataFrame, keys: Sequence[str], rules: Rules = BOUNDS, key: str = "variable",
    value: str = "value", inclusive: bool = True,
) -> DataFrame:
    """Count and bounds per series with violations."""
    return (
        violations(df, rules, key, value, inclusive).filter("violation")
        .groupBy(*keys, "low", "high").agg(F.count(F.lit(1)).alias("violations"))
    )


def bounds_examples(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None, rules: Rules = BOUNDS,
    key: str = "variable", value: str = "value",
) -> DataFrame:
    """Violations per series, ranked; all, or the first `n` as examples."""
    bad = violations(df, rules, key, value).filter("violation")
    if n is not None:
        return top_rows(bad, keys, [F.col(c) for c in order], n)
    return running_total(bad, keys, order, F.lit(1).cast("bigint"), "rank").withColumn("rank", F.col("rank").cast("int"))


def clean_weather(df: DataFrame, rain: str = "precip_in", missing: float = -999.0) -> DataFrame:
    """Missing marker to NULL in every number; rain is then filled with 0 and never negative."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    out = df.withColumns({c: F.when(F.col(c) != missing, nan_to_null(F.col(c))) for c in numbers})
    return out.withColumn(rain, F.greatest(F.coalesce(F.col(rain), F.lit(0.0)), F.lit(0.0)))


def rain_spikes(df: DataFrame, keys: Sequence[str] = (), rain: str = "precip_in", limit: float = 1.5) -> DataFrame:
    """Largest single increment and whether it is suspicious."""
    return df.groupBy(*keys).agg(F.max(rain).alias("max_rain")).withColumn(
        "spike", F.coalesce(F.col("max_rain") > limit, F.lit(False))
    )


def unit_twins(df: DataFrame) -> DataFrame:
    """Both unit systems side by side for rain and air temperature; the missing one is derived."""
    have = set(df.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    return df.withColumns({
        "precip_in": F.coalesce(col("precip_in"), col("precip_mm") / F.lit(25.4)),
        "precip_mm": F.coalesce(col("precip_mm"), col("precip_in") * F.lit(25.4)),
        "temp_air_degF": F.coalesce(col("temp_air_degF"), to_fahrenheit(col("temp_air_degC"))),
        "temp_air_degC": F.coalesce(col("temp_air_degC"), to_celsius(col("temp_air_degF"))),
    })


def convert_units(df: DataFrame, system: str, suffix_only: Sequence[str] | None = None) -> DataFrame:
    """Numbers in the asked system, chosen by column-name suffix; names stay."""
    names = suffix_only or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: converted(c, system) for c in names})
