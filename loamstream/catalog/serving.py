"""QRY-*: the serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CYLINDER_GAL
from ..operators import derive, resample as rs, seasons, series
from .base import IRRIGATION, ORDER_TIMES, READINGS, irrigation, order_times, query, readings
from .cleaning import CLEAN_WEATHER, HOURLY, hourly, pair_sql, weather
from ..operators.clean import clean_weather
from ..operators.events import on_grid
from .seasonal import CUSTOM, CUSTOM_SQL, IN, YEARS

RATIO = """t AS (SELECT *, CASE WHEN strip IN ('S1', 'S2') THEN 'S1' ELSE 'S3' END AS treated FROM hourly),
ratios AS (SELECT bin, location, depth, variable, treated, CASE treated WHEN 'S1' THEN 'S2' ELSE 'S4' END AS control,
  max(CASE WHEN strip = treated THEN value END) AS a, max(CASE WHEN strip <> treated THEN value END) AS b FROM t WHERE variable IN ('VWC', 'EC') GROUP BY ALL),
rt AS (SELECT bin, location, depth, variable, treated, control, a / CASE WHEN abs(b) >= 0.001 THEN b END AS ratio FROM ratios)"""


def _hour_weather(spark, sf):
    w = clean_weather(weather(spark, sf)).withColumn("bin", rs.bin_of("ts", "hourly"))
    return w.groupBy("bin").agg(F.round(F.sum("precip_in"), 6).alias("precip_in"), F.round(F.avg("temp_air_degF"), 6).alias("temp_air_degF"))


@query("QRY-01", f"""WITH {HOURLY}, {RATIO}, {CLEAN_WEATHER}, hw AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, round(sum(precip_in), 6) AS precip_in, round(avg(temp_air_degF), 6) AS temp_air_degF FROM clean GROUP BY 1)
SELECT t.bin, t.strip, t.location, t.depth, t.variable, round(t.value, 6) AS value, round(ratio, 6) AS ratio, precip_in, temp_air_degF
FROM t LEFT JOIN rt ON t.bin = rt.bin AND t.location = rt.location AND t.depth = rt.depth AND t.variable = rt.variable AND t.treated = rt.treated LEFT JOIN hw ON t.bin = hw.bin""")
def qry_01(spark, sf):
    h = hourly(spark, sf)
    out = series.load_joined(h, series.ratios_of(h), _hour_weather(spark, sf), "bin")
    return out.drop("treated").withColumns({c: F.round(c, 6) for c in ("value", "ratio")})


@query("QRY-02", f"""WITH {READINGS} SELECT ts, strip, location, depth, variable, value FROM readings
WHERE variable = 'VWC' AND strip = 'S1' AND location = 'T' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
UNION ALL SELECT ts, strip, location, depth, variable, value FROM readings
WHERE variable = 'EC' AND strip = 'S3' AND depth = '2' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def qry_02(spark, sf):
    r = readings(spark, sf)
    by_depth = series.raw_series(r, "VWC", "S1", "2024-01-05", "2024-01-20", location="T")
    by_place = series.raw_series(r, "EC", "S3", "2024-01-05", "2024-01-20", depth="2")
    return by_depth.unionByName(by_place)


@query("QRY-03", f"""WITH {HOURLY}, {RATIO} SELECT bin, treated, control, round(ratio, 6) AS ratio FROM rt
WHERE variable = 'VWC' AND depth = '1' AND location = 'M' AND bin >= TIMESTAMP '2024-01-05' AND bin <= TIMESTAMP '2024-01-20'""")
def qry_03(spark, sf):
    ratios = series.ratios_of(hourly(spark, sf))
    out = series.ratio_series(ratios, "SWC", "1", "M", "2024-01-05", "2024-01-20", "bin")
    return out.withColumn("ratio", F.round("ratio", 6))


@query("QRY-04", pair_sql("variable = 'T'", "a - b", "diff", src="(SELECT bin, strip, location, depth, variable, round_even(value, 3) AS value FROM hourly)").replace(
    "depth, variable, treated, control, round", "depth, treated, control, round"))
def qry_04(spark, sf):
    return series.temp_delta_series(readings(spark, sf), "hourly").withColumn("diff", F.round("diff", 6))


@query("QRY-05", f"WITH {CLEAN_WEATHER} SELECT ts, round(precip_in * 25.4, 6) AS rain FROM clean")
def qry_05(spark, sf):
    """Millimetres asked, inches stored."""
    w = clean_weather(weather(spark, sf))
    return series.rain_series(w, "metric").withColumn("rain", F.round("rain", 6))


@query("QRY-06", f"WITH {IRRIGATION} SELECT event_id, strip, start, round(gallons_strip * 3.78541 / 1000, 6) AS volume_k FROM irrigation")
def qry_06(spark, sf):
    out = series.irrigation_marks(irrigation(spark, sf), "metric")
    return out.select("event_id", "strip", "start", F.round("volume_k", 6).alias("volume_k"))


@query("QRY-06:periods", f"""WITH {ORDER_TIMES}, {CUSTOM_SQL} SELECT season_year, period_code, status AS strip, round_even(sum(value) / 1000, 3) AS irrigation_kgal
FROM order_times JOIN periods ON {IN} GROUP BY ALL""")
def qry_06_periods(spark, sf):
    ev = order_times(spark, sf).select(F.col("status").alias("strip"), F.col("ts").alias("start"), F.col("value").alias("gallons_strip"))
    grid = ev.select("strip").distinct().withColumn("season_year", F.explode(F.array(*[F.lit(y) for y in YEARS])))
    return seasons.season_irrigation(ev, grid, CUSTOM, year=None).drop("irrigation_gal")


@query("QRY-07", f"""WITH {READINGS}, v AS (SELECT 'all' AS p, strip, location, depth, round_even(avg(value / 100 * {CYLINDER_GAL!r}), 3) AS value FROM readings
  WHERE variable = 'VWC' AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-03-31 23:59:59.999999' GROUP BY ALL),
s AS (SELECT location, depth, treated, max(CASE WHEN strip = treated THEN value END) AS a, max(CASE WHEN strip <> treated THEN value END) AS b
  FROM (SELECT *, CASE WHEN strip IN ('S1', 'S2') THEN 'S1' ELSE 'S3' END AS treated FROM v) GROUP BY ALL)
SELECT 'Q1_Winter' AS period_code, location, depth, treated, CASE treated WHEN 'S1' THEN 'S2' ELSE 'S4' END AS control, a AS treated_value, b AS control_value, round(a / nullif(b, 0), 6) AS ratio FROM s
UNION ALL SELECT 'Q2_Early_Growing', location, depth, treated, CASE treated WHEN 'S1' THEN 'S2' ELSE 'S4' END, NULL, NULL, NULL FROM s""")
def qry_07(spark, sf):
    """Season bars of water volume and their treated/control ratio."""
    volume = derive.swc_volume(readings(spark, sf)).filter("variable = 'SWC_vol_gal'")
    bars = seasons.season_summary(volume, [2024], keys=["strip", "location", "depth"], is_sum=F.lit(False))
    out = seasons.season_series(bars, ["period_code", "location", "depth"], "strip", (("S1", "S2"), ("S3", "S4")))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("QRY-08", f"""WITH {HOURLY}, {RATIO}, u AS (
  SELECT strip, location, value, 'raw' AS kind FROM hourly WHERE variable = 'VWC' AND strip = 'S1' AND depth = '1' AND bin >= TIMESTAMP '2024-01-03' AND bin < TIMESTAMP '2024-01-29'
  UNION ALL SELECT treated || '_' || control, location, ratio, 'ratio' FROM rt WHERE variable = 'VWC' AND depth = '1' AND bin >= TIMESTAMP '2024-01-03' AND bin < TIMESTAMP '2024-01-29' AND ratio IS NOT NULL)
SELECT strip, location, kind, round_even(min(value), 4) AS min, round_even(avg(value), 4) AS mean, round_even(max(value), 4) AS max, round_even(stddev_samp(value), 4) AS std FROM u GROUP BY ALL""")
def qry_08(spark, sf):
    h = hourly(spark, sf)
    return series.summary_query(h, series.ratios_of(h), "VWC", "S1", "1", "2024-01-03", "2024-01-28")


@query("QRY-09", f"""WITH {READINGS}, {IRRIGATION}, vwc AS (SELECT strip, location, depth, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM readings WHERE variable = 'VWC' GROUP BY ALL) SELECT i.event_id, r.ts, r.depth, r.value, round(date_diff('microsecond', i.start, i."end") / 3.6e9, 6) AS duration_h,
  round(gallons_strip / (date_diff('microsecond', i.start, i."end") / 3.6e9), 6) AS avg_flow_gph
FROM irrigation i JOIN vwc r ON i.strip = r.strip AND i.location = r.location AND r.ts >= i.start - to_hours(6) AND r.ts <= i.start + to_hours(36)""")
def qry_09(spark, sf):
    vwc = on_grid(readings(spark, sf).filter("variable = 'VWC'"))
    out = series.event_extract(vwc, irrigation(spark, sf), ["strip", "location"], digits=6)
    return out.select("event_id", "ts", "depth", "value", "duration_h", "avg_flow_gph")
