"""CLN-*, DRV-* and AGG-*: cleaning, derivation, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..fixed_values import CYLINDER_GAL, CYLINDER_L
from ..functions import distance_ft
from ..operators import clean, derive, resample as rs, seasons
from ..plans.slices import floor_to
from .base import IRRIGATION, ORDER_TIMES, READINGS, irrigation, order_times, query, readings, table

SERIES = ["strip", "location", "depth", "variable"]


def r6(c):
    return F.round(c, 6)


@query("CLN-01", f"""WITH {READINGS}, copies AS (
  SELECT strip, location, time_bucket(INTERVAL 1 HOUR, ts) AS ts, variable, value, CAST(row_no % 3 AS INTEGER) AS source_rank, row_no FROM readings)
SELECT strip, location, ts, variable, value, source_rank, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY strip, location, ts, variable ORDER BY source_rank DESC, row_no DESC) AS k FROM copies)
WHERE k = 1""")
def cln_01(spark, sf):
    copies = readings(spark, sf).select(
        "strip", "location", floor_to("ts", 3600).alias("ts"), "variable", "value",
        (F.col("row_no") % 3).cast("int").alias("source_rank"), "row_no",
    )
    return clean.dedupe_last(copies, ["strip", "location", "ts", "variable"])


@query("CLN-02", f"""WITH {READINGS}
SELECT row_no, CASE WHEN abs(value) < 100 THEN value END AS value FROM readings""")
def cln_02(spark, sf):
    return clean.mask_sentinels(readings(spark, sf), 100.0).select("row_no", "value")


BAD = """CASE variable WHEN 'VWC' THEN value < 1 OR value > 80 WHEN 'T' THEN value < -30 OR value > 110
  WHEN 'EC' THEN value < -0.05 OR value > 20 ELSE false END"""


@query("CLN-03", f"""WITH {READINGS}
SELECT row_no, variable, CASE WHEN NOT ({BAD}) THEN value END AS value FROM readings""")
def cln_03(spark, sf):
    return clean.enforce_bounds(readings(spark, sf)).select("row_no", "variable", "value")


@query("CLN-04", f"""WITH {READINGS}, b AS (SELECT *, CASE variable WHEN 'VWC' THEN 1.0 WHEN 'T' THEN -30.0 ELSE -0.05 END::DOUBLE AS low,
  CASE variable WHEN 'VWC' THEN 80.0 WHEN 'T' THEN 110.0 ELSE 20.0 END::DOUBLE AS high FROM readings WHERE {BAD})
SELECT strip, location, depth, variable, low, high, CAST(count(*) AS BIGINT) AS violations FROM b GROUP BY ALL""")
def cln_04(spark, sf):
    return clean.bounds_report(readings(spark, sf), SERIES)


@query("CLN-04:examples", f"""WITH {READINGS}, b AS (SELECT *,
  row_number() OVER (PARTITION BY strip, location, depth, variable ORDER BY ts, row_no) AS rank FROM readings WHERE {BAD})
SELECT strip, location, depth, variable, ts, value, CAST(rank AS INTEGER) AS rank FROM b""")
def cln_04_examples(spark, sf):
    found = clean.bounds_examples(readings(spark, sf), SERIES, ["ts", "row_no"])
    return found.select(*SERIES, "ts", "value", "rank")


@query("CLN-05", f"""WITH {READINGS}
SELECT row_no, round(CASE variable WHEN 'VWC' THEN value * 100 WHEN 'T' THEN value * 9 / 5 + 32 ELSE value END, 6) AS value FROM readings""")
def cln_05(spark, sf):
    return clean.scale_units(readings(spark, sf)).select("row_no", r6(F.col("value")).alias("value"))


STRIPS = ("S1", "S2", "S3", "S4")
WIDE = [f"{v}_{d}_raw_{s}_{l}" for v in ("VWC", "T", "EC", "precip") for d in "123" for s in STRIPS for l in "TMB"] + [
    f"BattV_Min_{s}_{l}" for s in STRIPS for l in "TMB"]


def _wide_test(name):
    where = f"strip = '{name[-4:-2]}' AND location = '{name[-1]}'"
    if name.startswith("BattV_Min"):
        return f"variable = 'BattV_Min' AND {where}"
    variable, depth = name.split("_")[:2]
    return f"variable = '{variable}' AND depth = '{depth}' AND {where}"


@query("CLN-06", f"""WITH {READINGS}
SELECT ts, strip, location, CASE WHEN variable <> 'BattV_Min' THEN depth END AS depth, variable, max(value) AS value FROM readings GROUP BY ALL""")
def cln_06(spark, sf):
    """Long to wide and back; names are built and parsed on the way."""
    return schema.to_long(schema.to_wide(readings(spark, sf), WIDE))


@query("CLN-06:wide", f"""WITH {READINGS}
SELECT ts, {', '.join(f"max(CASE WHEN {_wide_test(n)} THEN value END) AS {n}" for n in WIDE)}
FROM readings GROUP BY ts""")
def cln_06_wide(spark, sf):
    return schema.to_wide(readings(spark, sf), WIDE)


@query("CLN-07", f"""WITH {READINGS}
SELECT ts, variable, {', '.join(f"max(CASE WHEN strip = '{s}' THEN value END) AS {s.lower()}" for s in STRIPS)}
FROM (SELECT * REPLACE (time_bucket(INTERVAL 15 MINUTE, ts) AS ts) FROM readings) GROUP BY ts, variable""")
def cln_07(spark, sf):
    """Loggers aligned on time: the union is the outer join, the aggregation the alignment."""
    r = readings(spark, sf).withColumn("ts", floor_to("ts", 900))
    merged = schema.merge_loggers([r.filter(F.col("strip") == s) for s in STRIPS])
    return merged.groupBy("ts", "variable").agg(*[
        F.max(F.when(F.col("strip") == s, F.col("value"))).alias(s.lower()) for s in STRIPS])


WEATHER = """weather AS (SELECT event_id, ts,
    CASE WHEN event_id % 50 = 0 THEN -999.0 WHEN event_type = 'view' THEN value / 1000 WHEN event_type = 'error' THEN -value END AS precip_in,
    CASE WHEN event_id % 40 = 0 THEN -999.0 WHEN event_type = 'signup' THEN value END AS temp_air_degF FROM events)"""


def weather(spark, sf):
    """Rain increments from views (some missing marks, some negative), air temperature from signups."""
    kind, v, k = F.col("event_type"), F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", "ts",
        F.when(k % 50 == 0, -999.0).when(kind == "view", v / 1000).when(kind == "error", -v).alias("precip_in"),
        F.when(k % 40 == 0, -999.0).when(kind == "signup", v).alias("temp_air_degF"),
    )


CLEAN_WEATHER = WEATHER + """, clean AS (SELECT event_id, ts, greatest(coalesce(nullif(precip_in, -999.0), 0.0), 0.0) AS precip_in,
    nullif(temp_air_degF, -999.0) AS temp_air_degF FROM weather)"""


@query("CLN-08", f"WITH {CLEAN_WEATHER} SELECT event_id, ts, round(precip_in, 6) AS precip_in, temp_air_degF FROM clean")
def cln_08(spark, sf):
    return clean.clean_weather(weather(spark, sf)).withColumn("precip_in", r6(F.col("precip_in")))


@query("CLN-08:spikes", f"""WITH {CLEAN_WEATHER} SELECT CAST(ts AS DATE) AS day, round(max(precip_in), 6) AS max_rain,
  max(precip_in) > 0.25 AS spike FROM clean GROUP BY 1""")
def cln_08_spikes(spark, sf):
    w = clean.clean_weather(weather(spark, sf)).withColumn("day", F.to_date("ts"))
    return clean.rain_spikes(w, ["day"], limit=0.25).withColumn("max_rain", r6(F.col("max_rain")))


@query("CLN-09", f"""WITH {CLEAN_WEATHER} SELECT event_id, round(precip_in, 6) AS precip_in, round(precip_in * 25.4, 6) AS precip_mm,
  round(temp_air_degF, 6) AS temp_air_degF, round((temp_air_degF - 32) * 5 / 9, 6) AS temp_air_degC FROM clean""")
def cln_09(spark, sf):
    w = clean.unit_twins(clean.clean_weather(weather(spark, sf)))
    cols = ("precip_in", "precip_mm", "temp_air_degF", "temp_air_degC")
    return w.select("event_id", *[r6(F.col(c)).alias(c) for c in cols])


@query("CLN-10", """SELECT event_id, round((value - 32) * 5 / 9, 9) AS soil_degF, round(value * 25.4, 9) AS rain_in,
  round(value * 3.78541, 9) AS water_gal, round(value * 2.54, 9) AS depth_swc_in FROM events""")
def cln_10(spark, sf):
    v = F.col("value")
    base = table(spark, sf, "events").select(
        "event_id", v.alias("soil_degF"), v.alias("rain_in"), v.alias("water_gal"), v.alias("depth_swc_in"))
    out = clean.convert_units(base, "metric")
    return out.select("event_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# ------------------------------------------------------------------ derivation

HOURLY = f"""{READINGS}, hourly AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, strip, location, depth, variable,
    CASE WHEN variable = 'precip' THEN sum(value) ELSE avg(value) END AS value
  FROM readings GROUP BY 1, 2, 3, 4, 5)"""


def hourly(spark, sf):
    return rs.resample(readings(spark, sf), "hourly", digits=None).drop("n")


@query("DRV-01", f"""WITH {READINGS} SELECT row_no, 'SWC_vol_L' AS variable, round(value / 100 * {CYLINDER_L!r}, 6) AS value FROM readings WHERE variable = 'VWC'
UNION ALL SELECT row_no, 'SWC_vol_gal', round(value / 100 * {CYLINDER_GAL!r}, 6) FROM readings WHERE variable = 'VWC'""")
def drv_01(spark, sf):
    return derive.swc_volume(readings(spark, sf)).select("row_no", "variable", r6(F.col("value")).alias("value"))


def pair_sql(where: str, expr: str, name: str, src: str = "hourly", k: str = "") -> str:
    return f"""WITH {HOURLY}, t AS (SELECT bin, location, depth, variable, CASE WHEN strip IN ('S1', 'S2') THEN 'S1' ELSE 'S3' END AS treated, strip, value{k} AS value
  FROM {src} WHERE {where}), p AS (SELECT bin, location, depth, variable, treated, CASE treated WHEN 'S1' THEN 'S2' ELSE 'S4' END AS control,
    max(CASE WHEN strip = treated THEN value END) AS a, max(CASE WHEN strip <> treated THEN value END) AS b FROM t GROUP BY ALL)
SELECT bin, location, depth, variable, treated, control, round({expr}, 6) AS {name} FROM p"""


BIN_KEYS = ["bin", "location", "depth", "variable"]


@query("DRV-02", pair_sql("variable = 'T'", "a - b", "diff"))
def drv_02(spark, sf):
    out = derive.pair_diff(hourly(spark, sf), ["T"], BIN_KEYS)
    return out.select(*BIN_KEYS, "treated", "control", r6(F.col("diff")).alias("diff"))


@query("DRV-03", pair_sql("variable = 'VWC'", "a - b", "diff", k=f" / 100 * {CYLINDER_GAL!r}").replace(
    "depth, variable, treated, control, round", "depth, 'SWC_vol_gal' AS variable, treated, control, round"))
def drv_03(spark, sf):
    volumes = derive.swc_volume(hourly(spark, sf))
    out = derive.pair_diff(volumes, ["SWC_vol_gal"], BIN_KEYS)
    return out.select(*BIN_KEYS, "treated", "control", r6(F.col("diff")).alias("diff"))


@query("DRV-04", """SELECT event_id, round(value / CASE WHEN abs(CAST(event_id % 5 AS DOUBLE) - 2) >= 0.001 THEN CAST(event_id % 5 AS DOUBLE) - 2 END, 6) AS ratio FROM events""")
def drv_04(spark, sf):
    den = (F.col("event_id") % 5).cast("double") - 2.0
    return table(spark, sf, "events").select("event_id", r6(derive.safe_ratio(F.col("value"), den)).alias("ratio"))


@query("DRV-05", pair_sql("variable IN ('VWC', 'EC')", "a / CASE WHEN abs(b) >= 0.001 THEN b END", "ratio"))
def drv_05(spark, sf):
    out = derive.pair_ratio(hourly(spark, sf), ("VWC", "EC"), BIN_KEYS)
    return out.select(*BIN_KEYS, "treated", "control", r6(F.col("ratio")).alias("ratio"))


@query("DRV-06", f"""WITH {READINGS} SELECT row_no, round(value / 100 * CAST(depth AS INTEGER) * 6 * 2.54, 6) AS water_depth FROM readings WHERE variable = 'VWC'""")
def drv_06(spark, sf):
    return derive.swc_depth(readings(spark, sf), "metric").select("row_no", r6(F.col("water_depth")).alias("water_depth"))


@query("DRV-07", f"""WITH {READINGS}, d AS (SELECT CAST(ts AS DATE) AS day, strip, location, CAST(depth AS INTEGER) * 6 AS z, avg(value) / 100 AS theta
  FROM readings WHERE variable = 'VWC' GROUP BY ALL),
l AS (SELECT day, strip, location, (theta + lead(theta) OVER w) / 2 * (lead(z) OVER w - z) AS layer, lead(z) OVER w - z AS dz
  FROM d WINDOW w AS (PARTITION BY day, strip, location ORDER BY z))
SELECT day, strip, location, round(sum(layer) * 100, 6) AS volume, round(sum(layer) / nullif(sum(dz), 0), 6) AS mean_theta,
  round(1000 - (sum(layer) * 100 - 50), 6) AS runoff FROM l GROUP BY ALL""")
def drv_07(spark, sf):
    daily = readings(spark, sf).filter("variable = 'VWC'").groupBy(
        F.to_date("ts").alias("day"), "strip", "location", (F.col("depth").cast("int") * 6).alias("z")
    ).agg((F.avg("value") / 100).alias("theta"))
    out = derive.profile_volume(daily, ["day", "strip", "location"], 100.0)
    return out.select(
        "day", "strip", "location", r6(F.col("volume")).alias("volume"), r6(F.col("mean_theta")).alias("mean_theta"),
        r6(derive.runoff(F.lit(1000.0), F.lit(50.0), F.col("volume"))).alias("runoff"))


@query("DRV-08", """SELECT c_custkey, round(sqrt(((c_nationkey / 10.0 - lon0) * 364000 * cos(radians((lat + lat0) / 2))) ** 2 + ((lat - lat0) * 364000) ** 2), 3) AS ft
FROM (SELECT *, 40 + c_acctbal / 1e6 AS lat, 40.5::DOUBLE AS lat0, 0.7::DOUBLE AS lon0 FROM customer)""")
def drv_08(spark, sf):
    lat, lon = 40 + F.col("c_acctbal") / 1e6, F.col("c_nationkey") / 10.0
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(distance_ft(F.lit(40.5), F.lit(0.7), lat, lon), 3).alias("ft"))


@query("DRV-09", f"""WITH {IRRIGATION}, g AS (SELECT *, 47.0 * 370.0 / 43560.0 AS acres FROM irrigation)
SELECT event_id, round(gallons_strip / 100 / acres, 6) AS lb_per_acre, round(gallons_strip / 100, 6) AS total_lb_back,
  round(gallons_strip / acres / (43560.0 / 12 * 7.48052), 6) AS inches_applied, round(gallons_strip / 500 / 47.0, 6) AS gpm_per_ft FROM g""")
def drv_09(spark, sf):
    ev = irrigation(spark, sf).select(
        "event_id", (F.col("gallons_strip") / 100).alias("total_lb"), F.col("gallons_strip").alias("gallons"),
        (F.col("gallons_strip") / 500).alias("gpm"))
    out = derive.to_rate(ev, F.lit(47.0), F.lit(370.0))
    names = ("lb_per_acre", "total_lb_back", "inches_applied", "gpm_per_ft")
    return out.select("event_id", *[r6(F.col(c)).alias(c) for c in names])


# ------------------------------------------------------------------ aggregation

def resample_sql(bucket: str) -> str:
    return f"""WITH {READINGS} SELECT {bucket} AS bin, strip, location, depth, variable,
  round_even(CASE WHEN variable = 'precip' THEN sum(value) ELSE avg(value) END, 3) AS value, CAST(count(value) AS BIGINT) AS n
FROM readings GROUP BY 1, 2, 3, 4, 5"""


for _grain, _step in (("15min", "15 MINUTE"), ("hourly", "1 HOUR"), ("daily", "1 DAY")):
    query("AGG-01" if _grain == "daily" else f"AGG-01:{_grain}", resample_sql(f"time_bucket(INTERVAL {_step}, ts)"))(
        lambda spark, sf, g=_grain: rs.resample(readings(spark, sf), g)
    )


@query("AGG-02", f"""WITH {ORDER_TIMES} SELECT status, variable, CAST(last_day(ts) AS TIMESTAMP) AS bin, round_even(avg(value), 3) AS value,
  CAST(count(value) AS BIGINT) AS n FROM order_times GROUP BY ALL""")
def agg_02(spark, sf):
    return rs.resample(order_times(spark, sf), "monthly", ["status", "variable"])


@query("AGG-03", f"""WITH {READINGS}, m AS (SELECT *, CASE WHEN abs(value) < 20 THEN value END AS v FROM readings)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, strip, location, round_even(avg(v), 3) AS value, CAST(count(v) AS BIGINT) AS n
FROM m GROUP BY ALL HAVING count(v) > 0""")
def agg_03(spark, sf):
    """Bins left with nothing after masking disappear."""
    masked = clean.mask_sentinels(readings(spark, sf), 20.0)
    return rs.resample(masked, "hourly", ["strip", "location"], is_sum=F.lit(False))


@query("AGG-04", f"""WITH {READINGS}, b AS (SELECT strip, variable, time_bucket(INTERVAL 15 MINUTE, ts) AS bin, sum(value) AS s, count(value) AS n
  FROM readings GROUP BY ALL), g AS (SELECT strip, variable, unnest(generate_series(min(bin), max(bin), INTERVAL 15 MINUTE)) AS bin FROM b GROUP BY strip, variable)
SELECT strip, variable, bin, CASE WHEN variable = 'precip' THEN round_even(coalesce(s, 0), 3) ELSE round_even(s / n, 3) END AS value, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM g LEFT JOIN b USING (strip, variable, bin)""")
def agg_04(spark, sf):
    return rs.resample_filled(readings(spark, sf), "15min", ["strip", "variable"])


@query("AGG-05", f"""WITH {READINGS} SELECT strip, variable, time_bucket(INTERVAL 15 MINUTE, ts - to_microseconds(1)) + INTERVAL 15 MINUTE AS bin,
  round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY ALL HAVING count(*) >= 2""")
def agg_05(spark, sf):
    out = rs.resample_bins(readings(spark, sf), 900, ["strip", "variable"], min_samples=2)
    return out.withColumn("value", r6(F.col("value")))


@query("AGG-05:last", f"""WITH {READINGS} SELECT strip, variable, time_bucket(INTERVAL 1 HOUR, ts) AS bin,
  arg_max(value, ts) AS value, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY ALL""")
def agg_05_last(spark, sf):
    return rs.resample_bins(readings(spark, sf), 3600, ["strip", "variable"], "last", label="start")


@query("AGG-06", f"""WITH {READINGS}, e AS (SELECT strip, variable, time_bucket(INTERVAL 15 MINUTE, min(ts)) AS a,
    time_bucket(INTERVAL 15 MINUTE, max(ts) - to_microseconds(1)) + INTERVAL 15 MINUTE AS b FROM readings GROUP BY ALL),
g AS (SELECT strip, variable, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS bin FROM e),
prv AS (SELECT g.strip, g.variable, g.bin, r.ts, r.value FROM g ASOF LEFT JOIN readings r ON g.strip = r.strip AND g.variable = r.variable AND g.bin >= r.ts),
nxt AS (SELECT g.strip, g.variable, g.bin, r.ts, r.value FROM g ASOF LEFT JOIN readings r ON g.strip = r.strip AND g.variable = r.variable AND g.bin < r.ts),
m AS (SELECT p.strip, p.variable, p.bin, CASE WHEN p.ts IS NOT NULL AND (n.ts IS NULL OR p.bin - p.ts <= n.ts - p.bin) THEN p.ts ELSE n.ts END AS sample_ts,
  CASE WHEN p.ts IS NOT NULL AND (n.ts IS NULL OR p.bin - p.ts <= n.ts - p.bin) THEN p.value ELSE n.value END AS value
  FROM prv p JOIN nxt n USING (strip, variable, bin))
SELECT strip, variable, bin, sample_ts, value FROM m WHERE abs(date_diff('microsecond', sample_ts, bin)) <= 600000000""")
def agg_06(spark, sf):
    return rs.resample_nearest(readings(spark, sf), 900, ["strip", "variable"], 600.0, order=["row_no"])


@query("AGG-07", f"""WITH {READINGS}, ok AS (SELECT * FROM readings WHERE NOT ({BAD}) AND abs(value) < 10000),
d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS bin, strip, location, depth, variable,
  CASE WHEN variable = 'precip' THEN sum(value) ELSE avg(value) END AS value FROM ok GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT strip, location, depth, variable, count(*) AS violations FROM readings WHERE {BAD} GROUP BY ALL)
SELECT strip, location, depth, variable, round_even(min(value), 4) AS min, round_even(avg(value), 4) AS mean, round_even(max(value), 4) AS max,
  round_even(stddev_samp(value), 4) AS std, CAST(coalesce(any_value(violations), 0) AS BIGINT) AS violations
FROM d LEFT JOIN v USING (strip, location, depth, variable) GROUP BY strip, location, depth, variable""")
def agg_07(spark, sf):
    """Flagship: mask, bound with report, daily means, statistics per series."""
    raw = clean.mask_sentinels(readings(spark, sf))
    daily = rs.resample(clean.enforce_bounds(raw), "daily", digits=None)
    report = clean.bounds_report(raw, SERIES).drop("low", "high")
    return rs.summary_stats(daily, SERIES).join(report, SERIES, "left").withColumn(
        "violations", F.coalesce("violations", F.lit(0)).cast("bigint"))


@query("AGG-08", f"""WITH {READINGS} SELECT strip, variable, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75
FROM readings GROUP BY ALL""")
def agg_08(spark, sf):
    out = rs.describe_series(readings(spark, sf), ["strip", "variable"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


@query("AGG-09", f"""WITH {ORDER_TIMES} SELECT CASE WHEN ts >= TIMESTAMP '1996-11-01' AND ts <= TIMESTAMP '1997-03-31 23:59:59.999999' THEN 'Q1_Winter' ELSE 'Q2_Early_Growing' END AS period_code,
  status, variable, round(sum(value * value) / count(*), 2) AS mean_square, CAST(count(*) AS BIGINT) AS n
FROM order_times WHERE ts >= TIMESTAMP '1996-11-01' AND ts <= TIMESTAMP '1997-10-31 23:59:59.999999' GROUP BY ALL""")
def agg_09(spark, sf):
    return rs.build_summary(
        order_times(spark, sf), seasons.assign_season("ts", 1997), ["status", "variable"],
        {"mean_square": lambda v: F.round(F.avg(v * v), 2), "n": lambda v: F.count(F.lit(1))})


@query("AGG-10", f"""WITH {READINGS}, r AS (SELECT variable, depth, min(value) AS lo, max(value) AS hi, max(abs(value - 50)) AS m FROM readings GROUP BY ALL)
SELECT variable, depth, CASE WHEN lo = hi THEN lo - abs(lo) * 0.1 ELSE lo END AS low, CASE WHEN lo = hi THEN hi + abs(lo) * 0.1 ELSE hi END AS high,
  round(CASE WHEN m <= 0 THEN 1.05 ELSE m * 1.05 END, 6) AS half_range FROM r""")
def agg_10(spark, sf):
    r = readings(spark, sf).withColumn("diff", F.col("value") - 50.0)
    half = rs.symmetric_range(r, ["variable", "depth"])
    return rs.value_range(r, ["variable", "depth"]).join(half, ["variable", "depth"]).withColumn(
        "half_range", r6(F.col("half_range")))


@query("AGG-11", f"""WITH {READINGS}, {IRRIGATION}, x AS (SELECT r.depth, r.value FROM irrigation i JOIN readings r ON i.strip = r.strip AND i.location = r.location
  AND r.ts >= i.start - to_hours(6) AND r.ts <= i.start + to_hours(36) WHERE r.variable = 'VWC'),
e AS (SELECT depth, min(value) AS lo, max(value) AS hi FROM x GROUP BY depth)
SELECT depth, round(lo - CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 1 END, 6) AS low, round(hi + CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 1 END, 6) AS high FROM e""")
def agg_11(spark, sf):
    vwc = readings(spark, sf).filter("variable = 'VWC'")
    out = rs.event_window_range(vwc, irrigation(spark, sf), ["strip", "location"], by=["depth"])
    return out.select("depth", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))
