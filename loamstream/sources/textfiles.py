"""Line files with per-file headers, read as splittable text.

A file may be far larger than one task should hold, so nothing reads a whole file into a row. Line
order inside a file is (block start, line id): the id grows along a split and never leaves it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import machine_name, nan_to_null
from ..operators.timeops import parse_ts
from ..plans import top_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with `file`, and `block`, `line_id` that order them inside the file."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.regexp_replace("value", "^﻿", "").alias("line"),
    )


# a comma and the cell after it; quoted cells are taken whole, in one pass over the line
CELL = r',[ \t]*("(?:[^"]++|"")*+"|[^,]*)'


def split_cells(line: Column) -> Column:
    """Cells of a CSV line as trimmed text; quoted cells may hold commas and doubled quotes."""
    bare = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1)), lambda c: F.regexp_replace(F.trim(c), r'^"|"$', ""))
    return F.transform(bare, lambda c: F.trim(F.replace(c, F.lit('""'), F.lit('"'))))


def file_headers(lines: DataFrame, n: int) -> DataFrame:
    """The first `n` lines of every file with their 1-based number.

    They sit in the file's first block; each map task keeps `n` of them before the shuffle.
    """
    first = top_rows(lines.filter("block = 0"), ["file"], [F.col("line_id")], n)
    return first.select("file", "line_id", "line", F.col("rank").alias("line_no"))


def read_with_headers(spark: SparkSession, path: str, header_lines: int, name_line: int) -> DataFrame:
    """Data lines with their file's column names as array `names` and cells as array `cells`."""
    lines = read_lines(spark, path)
    heads = file_headers(lines, header_lines)
    per_file = heads.groupBy("file").agg(
        F.max("line_id").alias("_last"), F.max(F.when(F.col("line_no") == name_line, F.col("line"))).alias("_names"))
    body = lines.join(per_file, "file").filter((F.col("block") > 0) | (F.col("line_id") > F.col("_last")))
    return body.filter(F.trim("line") != "").select(
        "file", "block", "line_id", split_cells(F.col("_names")).alias("names"), split_cells(F.col("line")).alias("cells"))


def read_toa5(spark: SparkSession, path: str, tag_pattern: str = r"(S\d)([TMB])[^/]*$") -> tuple[DataFrame, DataFrame]:
    """Logger files to long readings; also the lines whose time cannot be read.

    Line 2 names the columns, four lines are header, blank, NA and NAN are missing. Columns follow
    the file they are in, so old files without a column simply bring no rows for it. `VWC_1_Avg`
    becomes variable VWC, depth 1; the logger comes from the file name. RECORD is kept as `record`
    for order checks and is not a reading.
    """
    rows = read_with_headers(spark, path, 4, 2)
    pairs = F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("c"))
    named = rows.select("file", "block", "line_id", F.filter(pairs, lambda p: p["n"].isNotNull()).alias("_p"))

    def cell(*names: str) -> Column:
        return F.get(F.filter("_p", lambda p: F.upper(p["n"]).isin(*names)), F.lit(0))["c"]

    timed = named.withColumns({"_ts": cell("TIMESTAMP"), "record": cell("RECORD").try_cast("bigint")})
    good, bad = parse_ts(timed, "_ts")
    readings = F.filter("_p", lambda p: ~F.upper(p["n"]).isin("TIMESTAMP", "RECORD"))
    cells = good.withColumn("_c", F.explode(readings)).withColumns({
        "variable": F.regexp_extract("_c.n", r"^(VWC|T|EC)_\d_|^(BattV_Min)$", 0), "depth": F.nullif(F.regexp_extract("_c.n", r"^(?:VWC|T|EC)_(\d)_", 1), F.lit("")),
        "value": nan_to_null(F.when(~F.upper("_c.c").isin("", "NA", "NAN"), F.col("_c.c")).try_cast("double")),
        "strip": F.regexp_extract("file", tag_pattern, 1), "location": F.regexp_extract("file", tag_pattern, 2),
    })
    cells = cells.withColumn("variable", F.regexp_replace("variable", r"_\d_$", "")).filter("variable <> ''")
    return cells.select("ts", "strip", "location", "depth", "variable", "value", "record", "file", "block", "line_id"), bad.select(
        "file", "line_id", F.col("_ts").alias("raw"))


# fixed values: station headers and the names they get, by unit system
WEATHER_NAMES = {
    "us": {
        "Air Temp": "temp_air_degF", "RH": "rh_%", "Dewpoint": "dewpoint_degF", "Vapor Pressure": "vapor_pressure_psi",
        "Solar Rad": "solar_rad_Wm2", "Liquid Precip": "precip_in", "Wind": "wind_speed_mph", "Wind Dir": "wind_dir_degN",
        "5cm Soil Temp": "soil_temp_2in_degF", "15cm Soil Temp": "soil_temp_6in_degF",
    },
    "metric": {
        "Air Temp": "temp_air_degC", "RH": "rh_%", "Dewpoint": "dewpoint_degC", "Vapor Pressure": "vapor_pressure_kPa",
        "Solar Rad": "solar_rad_Wm2", "Liquid Precip": "precip_mm", "Wind": "wind_speed_m_s", "Wind Dir": "wind_dir_degN",
        "5cm Soil Temp": "soil_temp_5cm_degC", "15cm Soil Temp": "soil_temp_15cm_degC",
    },
}


def read_weather_csv(spark: SparkSession, path: str, units: str = "us", missing: str = "-999") -> DataFrame:
    """Station files: a name line, a units line, then rows; −999 is missing, names get units.

    The units row and anything else without a readable time is dropped.
    """
    names = WEATHER_NAMES[units]
    rows = read_with_headers(spark, path, 1, 1)
    table = F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("c")), lambda p: p["n"].isNotNull()))
    timed = rows.withColumn("_m", table).withColumn(
        "timestamp", F.coalesce(*[F.try_to_timestamp(F.col("_m")["Date and Time"], F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")]).cast("timestamp_ntz"))
    number = {new: nan_to_null(F.col("_m")[old].try_cast("double")) for old, new in names.items()}
    return timed.filter("timestamp IS NOT NULL").select(
        "timestamp", *[F.when(c != F.lit(float(missing)), c).alias(n) for n, c in number.items()])


def read_two_header_csv(spark: SparkSession, path: str, key_columns: Sequence[str] = ("strip", "date_rec"), suffix: str = "_pct_db") -> tuple[DataFrame, dict[str, str]]:
    """Lab files, all text, with the human header of each machine name.

    Every file follows its own header. One line is enough when it already has a key column or a
    dry-basis name; otherwise line 1 is for people and line 2 for machines. Columns are the union of
    all names, in the order files and columns first show them; a file without a column has "" there.
    Only distinct header pairs reach the driver.
    """
    lines = read_lines(spark, path)
    heads = file_headers(lines, 2).groupBy("file").agg(*[
        F.max(F.when(F.col("line_no") == i, F.col("line"))).alias(f"l{i}") for i in (1, 2)],
        *[F.max(F.when(F.col("line_no") == i, F.col("line_id"))).alias(f"at{i}") for i in (1, 2)])
    h1, h2 = split_cells(F.col("l1")), F.coalesce(split_cells(F.col("l2")), F.array().cast("array<string>"))
    one = F.arrays_overlap(h1, F.array(*[F.lit(k) for k in key_columns])) | F.exists(h1, lambda c: c.endswith(suffix))
    named = F.transform(F.when(one, h1).otherwise(h2), lambda c, i: F.when(c == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(c))
    heads = heads.select("file", named.alias("_names"), h1.alias("_h1"), F.when(one, F.col("at1")).otherwise(F.coalesce("at2", "at1")).alias("_last"))
    pairs = heads.groupBy("_names", "_h1").agg(F.min("file").alias("file")).orderBy("file").collect()
    human: dict[str, str] = {}
    for r in pairs:
        names = list(r["_names"])
        while names and re.fullmatch(r"column_\d+", names[-1]):
            names.pop()
        for i, m in enumerate(names):
            human.setdefault(m, r["_h1"][i] if i < len(r["_h1"]) and r["_h1"][i] else m)
    body = lines.join(heads, "file").filter((F.col("block") > 0) | (F.col("line_id") > F.col("_last"))).filter(F.trim("line") != "")
    cells = F.filter(F.arrays_zip(F.col("_names").alias("n"), split_cells(F.col("line")).alias("c")), lambda p: p["n"].isNotNull())
    # a name used twice in one file means its first column
    firsts = F.filter(cells, lambda p, i: F.array_position(F.transform(F.slice(cells, 1, i + 1), lambda q: q["n"]), p["n"]) == i + 1)
    rows = body.select(F.map_from_entries(firsts).alias("_m"))
    return rows.select(*[F.coalesce(F.col("_m")[m], F.lit("")).alias(m) for m in human]), human


def detect_header(rows: DataFrame, tokens: Sequence[str], cells: str = "cells", row_no: str = "row_no") -> DataFrame:
    """The first of the rows that mention most tokens, with clean, distinct names.

    One row: header_row, names. Repeats of a name get `_1`, `_2`, … in order; `&` is spelled `and`. Every
    row is scored where it is and the best one is kept by a combining maximum.
    """
    clean = F.transform(cells, lambda c: machine_name(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit(" and "))))
    text = F.array_join(F.col("_m"), " ")
    score = sum((F.when(text.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    best = rows.withColumn("_m", clean).withColumn("_score", score).groupBy().agg(
        F.max_by(F.struct(F.col(row_no).alias("header_row"), F.col("_m").alias("m")), F.struct("_score", -F.col(row_no))).alias("_b"))
    m = F.col("_b.m")

    def distinct_name(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(m, 1, i), lambda x: x == name))
        return F.when(before == 0, name).otherwise(F.concat(name, F.lit("_"), before.cast("string")))

    return best.select(F.col("_b.header_row").alias("header_row"), F.transform(m, distinct_name).alias("names"))


def apply_header(rows: DataFrame, header: DataFrame, cells: str = "cells", row_no: str = "row_no") -> DataFrame:
    """Rows below the header as named columns; the names (one row) decide the schema."""
    found = header.first()
    names = list(found["names"])
    below = rows.filter(F.col(row_no) > found["header_row"])
    out = below.select(row_no, *[F.nullif(F.trim(F.get(F.col(cells), F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names) if n])
    return out.filter(F.coalesce(*[F.col(n) for n in names if n]).isNotNull())
