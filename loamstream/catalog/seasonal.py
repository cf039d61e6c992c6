"""GS-*: seasons over the long order history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as rs, seasons
from ..plans.slices import floor_to
from .base import ORDER_TIMES, order_times, query

YEARS = (1996, 1997, 1998)
CUSTOM = seasons.normalize_periods({
    "spring": {"start": "2024-03-01", "end": "2024-05-31"},
    "wet_time": {"label": "Wet", "start": "10-15", "end": "02-28"},
    "year": {"start": "01-01", "end": "12-31"},
})

DAILY = f"""{ORDER_TIMES}, daily AS (SELECT date_trunc('day', ts) AS ts, status, variable, avg(value) AS value
  FROM order_times GROUP BY ALL)"""


def period_sql(rows: list[tuple[str, str, str, str, bool]]) -> str:
    """SQL for the period table: code, label, first and last day for each of YEARS."""
    parts = []
    for i, (code, label, start, end, wraps) in enumerate(rows):
        first = "y - 1" if wraps else "y"
        parts.append(
            f"SELECT CAST(y AS INTEGER) AS season_year, {i} AS ord, '{code}' AS period_code, '{label}' AS period_label, "
            f"make_date(CAST({first} AS INTEGER), {int(start[:2])}, {int(start[3:])}) AS a, make_date(CAST(y AS INTEGER), {int(end[:2])}, {int(end[3:])}) AS b "
            f"FROM (SELECT unnest([1996, 1997, 1998]) AS y)")
    return "periods AS (" + " UNION ALL ".join(parts) + ")"


DEFAULT_SQL = period_sql([("Q1_Winter", "Winter", "11-01", "03-31", True), ("Q2_Early_Growing", "Growing Season", "04-01", "10-31", False)])
CUSTOM_SQL = period_sql([("spring", "spring", "03-01", "05-31", False), ("wet_time", "Wet", "10-15", "02-28", True), ("year", "year", "01-01", "12-31", False)])
IN = "ts >= a AND ts < b + INTERVAL 1 DAY"


def daily(spark, sf):
    """Daily means, not rounded here: a mean of rounded means lies on rounding ties too often to compare."""
    return rs.resample(order_times(spark, sf), "daily", ["status", "variable"], digits=None).drop("n").withColumnRenamed("bin", "ts")


@query("GS-01", f"""WITH {ORDER_TIMES} SELECT row_no, CASE WHEN ts >= TIMESTAMP '1996-11-01' AND ts <= TIMESTAMP '1997-03-31 23:59:59.999999' THEN 'Q1_Winter'
  WHEN ts >= TIMESTAMP '1997-04-01' AND ts <= TIMESTAMP '1997-10-31 23:59:59.999999' THEN 'Q2_Early_Growing' END AS season FROM order_times""")
def gs_01(spark, sf):
    return order_times(spark, sf).select("row_no", seasons.assign_season("ts", 1997).alias("season"))


def summary_sql(rows: str, periods: str, value: str = "value", rain: str = "false") -> str:
    return f"""WITH {DAILY}, {periods}, series AS (SELECT DISTINCT status, variable FROM {rows}),
  f AS (SELECT season_year, period_code, status, variable, sum({value}) AS s, count({value}) AS n FROM {rows} JOIN periods ON {IN} GROUP BY ALL)
SELECT season_year, period_code, period_label, a AS period_start, b AS period_end, status, variable,
  CASE WHEN {rain} THEN round_even(coalesce(s, 0), 3) ELSE round_even(s / n, 3) END AS value
FROM series CROSS JOIN periods LEFT JOIN f USING (season_year, period_code, status, variable)"""


@query("GS-02", summary_sql("daily", DEFAULT_SQL))
def gs_02(spark, sf):
    return seasons.season_summary(daily(spark, sf), YEARS, keys=["status", "variable"])


@query("GS-03", summary_sql("order_times", CUSTOM_SQL))
def gs_03(spark, sf):
    """User periods on the raw rows; they may overlap."""
    return seasons.season_summary(order_times(spark, sf), YEARS, CUSTOM, ["status", "variable"])


@query("GS-03:rain", summary_sql("order_times", CUSTOM_SQL, "greatest(value - 10000, 0)", "true"))
def gs_03_rain(spark, sf):
    """Rain-like increments: negatives count as 0 and the season takes the sum."""
    rows = order_times(spark, sf).withColumn("value", F.col("value") - 10000)
    return seasons.season_summary(rows, YEARS, CUSTOM, ["status", "variable"], is_sum=F.lit(True), clip=True)


STATS = """round_even(min(value), 4) AS min, round_even(avg(value), 4) AS mean, round_even(max(value), 4) AS max, round_even(stddev_samp(value), 4) AS std"""


@query("GS-04", f"""WITH {ORDER_TIMES} SELECT CASE WHEN ts <= TIMESTAMP '1997-03-31 23:59:59.999999' THEN 'Q1_Winter' ELSE 'Q2_Early_Growing' END AS period_code,
  status, variable, {STATS} FROM order_times WHERE ts >= TIMESTAMP '1996-11-01' AND ts <= TIMESTAMP '1997-10-31 23:59:59.999999' GROUP BY ALL""")
def gs_04(spark, sf):
    return seasons.season_stats(order_times(spark, sf), 1997, keys=["status", "variable"])


def _flat_parts(spark, sf):
    """Orders as a sensor set: status is the strip, priority digit the depth, hour parity the location."""
    from ..operators import derive

    rows = order_times(spark, sf).select(
        floor_to("ts", 86400).alias("ts"),
        F.when(F.col("status") == "F", "S1").when(F.col("status") == "O", "S2").otherwise("S3").alias("strip"),
        F.when(F.col("row_no") % 2 == 0, "T").otherwise("B").alias("location"),
        F.substring("variable", 1, 1).alias("depth"), F.lit("VWC").alias("variable"), "value",
    )
    means = rows.groupBy("ts", "strip", "location", "depth", "variable").agg(F.avg("value").alias("value"))
    raw = seasons.season_stats(means, 1997).withColumn("kind", F.lit("raw"))
    ratios = derive.pair_ratio(means, ("VWC",)).withColumn("strip", F.concat_ws("_", "treated", "control"))
    ratio = seasons.season_stats(ratios, 1997, value="ratio").withColumn("kind", F.lit("ratio"))
    return raw.unionByName(ratio)


FLAT = f"""WITH {ORDER_TIMES}, m AS (SELECT date_trunc('day', ts) AS ts, CASE status WHEN 'F' THEN 'S1' WHEN 'O' THEN 'S2' ELSE 'S3' END AS strip,
    CASE WHEN row_no % 2 = 0 THEN 'T' ELSE 'B' END AS location, substr(variable, 1, 1) AS depth, avg(value) AS value
  FROM order_times GROUP BY ALL),
p AS (SELECT ts, location, depth, max(CASE strip WHEN 'S1' THEN value END) / max(CASE strip WHEN 'S2' THEN value END) AS value FROM m GROUP BY ALL),
u AS (SELECT ts, strip, location, depth, value, 'raw' AS kind FROM m UNION ALL SELECT ts, 'S1_S2', location, depth, value, 'ratio' FROM p),
s AS (SELECT CASE WHEN ts <= TIMESTAMP '1997-03-31 23:59:59.999999' THEN 'Q1_Winter' ELSE 'Q2_Early_Growing' END AS period_code, strip, location, depth, kind, {STATS}
  FROM u WHERE ts >= TIMESTAMP '1996-11-01' AND ts <= TIMESTAMP '1997-10-31 23:59:59.999999' AND value IS NOT NULL GROUP BY ALL)"""


@query("GS-05", FLAT + """ SELECT period_code, 'VWC' AS variable, strip, depth, location, """ + ", ".join(
    f"max(CASE kind WHEN '{k}' THEN {m} END) AS {k}_{m}" for k in ("raw", "ratio") for m in ("min", "mean", "max", "std")) +
    " FROM s GROUP BY period_code, strip, depth, location")
def gs_05(spark, sf):
    return seasons.season_stats_flat(_flat_parts(spark, sf))


SERIES_KEY = "strip || '_' || location || '_' || depth || '_' || kind"


@query("GS-05:nested", FLAT + f""" SELECT period_code, 'VWC' AS variable, '{{' || string_agg('"' || {SERIES_KEY} || '":{{' || concat_ws(',', '"min":' || min, '"mean":' || mean, '"max":' || max, '"std":' || std) || '}}', ',' ORDER BY {SERIES_KEY}) || '}}' AS stats
FROM s GROUP BY period_code""")
def gs_05_nested(spark, sf):
    """The same statistics as one JSON object per period and variable."""
    return seasons.season_nested(_flat_parts(spark, sf))


def _years(spark, sf):
    return order_times(spark, sf).select(F.year("ts").alias("season_year")).distinct()


ALL_YEARS = DEFAULT_SQL.replace("(SELECT unnest([1996, 1997, 1998]) AS y)", "(SELECT DISTINCT year(ts) AS y FROM order_times)")


@query("GS-06", f"""WITH {DAILY}, {ALL_YEARS} SELECT season_year, period_code, round(coalesce(sum(value / 1e6), 0), 6) AS precip_in, round(coalesce(sum(value / 1e6), 0) * 25.4, 6) AS precip_mm
FROM periods LEFT JOIN daily ON {IN} GROUP BY season_year, period_code""")
def gs_06(spark, sf):
    rain = daily(spark, sf).withColumn("precip_in", F.col("value") / 1e6)
    out = seasons.season_rain(rain, _years(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("precip_in", "precip_mm")})


def _events(spark, sf):
    return order_times(spark, sf).select(
        F.col("status").alias("strip"), F.col("ts").alias("start"), F.year("ts").alias("year"),
        F.col("value").alias("gallons_strip"))


def _strip_years(spark, sf):
    ev = _events(spark, sf)
    return ev.select("strip").distinct().withColumn("season_year", F.explode(F.array(*[F.lit(y) for y in YEARS])))


IRR = f"""WITH {DAILY}, {DEFAULT_SQL}, st AS (SELECT DISTINCT status AS strip FROM order_times),
irr AS (SELECT strip, season_year, period_code, round(coalesce(sum(value), 0), 2) AS irrigation_gal, round_even(coalesce(sum(value), 0) / 1000, 3) AS irrigation_kgal
  FROM st CROSS JOIN periods LEFT JOIN order_times ON {IN} AND status = strip AND year(ts) = season_year GROUP BY ALL)"""


@query("GS-07", IRR + " SELECT * FROM irr")
def gs_07(spark, sf):
    out = seasons.season_irrigation(_events(spark, sf), _strip_years(spark, sf))
    return out.withColumn("irrigation_gal", F.round("irrigation_gal", 2))


@query("GS-08", IRR + f""", rain AS (SELECT season_year, period_code, coalesce(sum(value), 0) / 1e6 AS p FROM periods LEFT JOIN daily ON {IN} GROUP BY ALL),
v AS (SELECT season_year, period_code, status AS strip, round_even(avg(value), 3) AS value FROM daily JOIN periods ON {IN} WHERE variable = '1-URGENT' GROUP BY ALL)
SELECT season_year, period_code, period_label, a AS period_start, b AS period_end, strip, value, round_even(p, 3) AS precip_in, round_even(p * 25.4, 3) AS precip_mm,
  round_even(irrigation_gal, 3) AS irrigation_gal, irrigation_kgal
FROM st CROSS JOIN periods LEFT JOIN v USING (season_year, period_code, strip) LEFT JOIN rain USING (season_year, period_code) LEFT JOIN irr USING (strip, season_year, period_code)""")
def gs_08(spark, sf):
    one = daily(spark, sf).filter("variable = '1-URGENT'").withColumnRenamed("status", "strip")
    values = seasons.season_summary(one, YEARS, keys=["strip"])
    years = spark.createDataFrame([(y,) for y in YEARS], "season_year int")
    rain = seasons.season_rain(daily(spark, sf).withColumn("precip_in", F.col("value") / 1e6), years)
    irr = seasons.season_irrigation(_events(spark, sf), _strip_years(spark, sf)).withColumn(
        "irrigation_gal", F.round("irrigation_gal", 2))
    return seasons.season_frame(values, rain, irr)


@query("GS-09", f"WITH {ORDER_TIMES}, {CUSTOM_SQL.replace('(SELECT unnest([1996, 1997, 1998]) AS y)', '(SELECT DISTINCT year(ts) AS y FROM order_times)')} "
       "SELECT season_year, ord, period_code, period_label, a AS period_start, b AS period_end FROM periods")
def gs_09(spark, sf):
    return seasons.period_rows(_years(spark, sf), CUSTOM)
