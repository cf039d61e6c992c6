"""Long readings, and the column-name convention that ties them to wide frames.

Wide names: `VAR_depth_raw_strip_loc`, `VAR_depth_ratio_a_b_loc`, `BattV_Min_strip_loc`,
`SWC_vol_{gal,L}_strip_loc_depth`. The long table is the unit of work; wide is a view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("strip", "location", "depth", "variable")

READINGS = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("strip", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("depth", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("source_rank", T.IntegerType()),
    T.StructField("row_no", T.LongType()),
])

# fixed patterns: wide column names
RAW_PATTERN = r"^([A-Za-z]+)_(\d)_raw_(S\d)_([A-Z])$"
RATIO_PATTERN = r"^([A-Za-z]+)_(\d)_ratio_(S\d_S\d)_([A-Z])$"
VOLUME_PATTERN = r"^(SWC_vol_(?:gal|L))_(S\d)_([A-Z])_(\d)$"
BATTERY_PATTERN = r"^(BattV_Min)_(S\d)_([A-Z])$"


def series_name() -> Column:
    """Wide column name of a long row."""
    v, d, s, l = (F.col(c) for c in ("variable", "depth", "strip", "location"))
    return (
        F.when(v == "BattV_Min", F.concat_ws("_", v, s, l))
        .when(v.startswith("SWC_vol_"), F.concat_ws("_", v, s, l, d))
        .otherwise(F.concat(v, F.lit("_"), d, F.lit("_raw_"), s, F.lit("_"), l))
    )


def parse_series_name(name: Column | str) -> Column:
    """Struct (variable, depth, strip, location, kind) of a wide column name; NULL if unknown."""
    c = F.col(name) if isinstance(name, str) else name

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    def row(variable: Column, depth: Column, strip: Column, location: Column, kind: str) -> Column:
        return F.struct(
            variable.alias("variable"), depth.alias("depth"), strip.alias("strip"),
            location.alias("location"), F.lit(kind).alias("kind"),
        )

    return (
        F.when(c.rlike(RAW_PATTERN), row(
            part(RAW_PATTERN, 1), part(RAW_PATTERN, 2), part(RAW_PATTERN, 3), part(RAW_PATTERN, 4), "raw"))
        .when(c.rlike(RATIO_PATTERN), row(
            part(RATIO_PATTERN, 1), part(RATIO_PATTERN, 2), part(RATIO_PATTERN, 3),
            part(RATIO_PATTERN, 4), "ratio"))
        .when(c.rlike(VOLUME_PATTERN), row(
            part(VOLUME_PATTERN, 1), part(VOLUME_PATTERN, 4), part(VOLUME_PATTERN, 2),
            part(VOLUME_PATTERN, 3), "raw"))
        .when(c.rlike(BATTERY_PATTERN), row(
            part(BATTERY_PATTERN, 1), F.lit(None).cast("string"), part(BATTERY_PATTERN, 2),
            part(BATTERY_PATTERN, 3), "raw"))
    )


def to_long(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Wide sensor frame to long rows; columns outside the naming convention are left out."""
    values = [c for c in df.columns if c != ts]
    # most cells of a wide row are empty: names are parsed for the others only
    melted = df.unpivot([ts], [F.col(c).cast("double").alias(c) for c in values], "name", "value").filter("value IS NOT NULL")
    return (
        melted.withColumn("_p", parse_series_name("name")).filter("_p IS NOT NULL")
        .select(ts, "_p.strip", "_p.location", "_p.depth", "_p.variable", "value")
    )


def to_wide(df: DataFrame, names: Sequence[str], ts: str = "ts") -> DataFrame:
    """Long rows to one column per listed series; the list keeps the schema fixed.

    Rows are reduced to one per instant and series first. An instant's cells are a map, bounded by the number of
    series, and the columns are looked up in it, so a row is not held against every listed name.
    """
    cells = df.withColumn("_name", series_name()).groupBy(ts, "_name").agg(F.max("value").alias("_v"))
    listed = F.col("_name").isin(*names) & F.col("_v").isNotNull()
    rows = cells.groupBy(ts).agg(F.map_from_entries(F.collect_list(F.when(listed, F.struct("_name", "_v")))).alias("_m"))
    return rows.select(ts, *[F.try_element_at("_m", F.lit(n)).alias(n) for n in names])


def merge_loggers(frames: Sequence[DataFrame]) -> DataFrame:
    """All loggers on one time line: in long form an outer alignment is a union."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
