"""DQ-*, CLK-*, BAT-*: diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import battery as bt, clocks as ck, quality as dq
from ..operators.timeops import dst_transitions
from ..plans.slices import floor_to, shift
from .base import ORDER_TIMES, READINGS, order_times, query, readings, table
from .timing import US_RULE

STEP = "date_diff('microsecond', prev_ts, ts) / 6e7"
LOGGER = ["strip", "location"]


def r6(c):
    return F.round(c, 6)


def coarse(spark, sf):
    """Readings on a 15-minute grid, so instants repeat."""
    return readings(spark, sf).withColumn("ts", floor_to("ts", 900))


COARSE = f"{READINGS}, coarse AS (SELECT * REPLACE (time_bucket(INTERVAL 15 MINUTE, ts) AS ts) FROM readings)"
LAGGED = f"""WITH {COARSE}, i AS (SELECT strip, location, ts, count(*) AS copies FROM coarse GROUP BY ALL),
l AS (SELECT *, lag(ts) OVER (PARTITION BY strip, location ORDER BY ts) AS prev_ts FROM i), s AS (SELECT *, {STEP} AS step FROM l)"""


@query("DQ-01", LAGGED + " SELECT strip, location, prev_ts AS gap_start, ts AS gap_end, step AS gap_minutes FROM s WHERE step >= 60")
def dq_01(spark, sf):
    return dq.gaps(coarse(spark, sf), LOGGER)


CONT = LAGGED + """ SELECT strip, location, CAST(sum(copies) AS BIGINT) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(copies - 1) AS BIGINT) AS n_duplicates,
  CAST(count(*) FILTER (step > 15) AS BIGINT) AS n_gaps, CAST(count(*) FILTER (step <> 0 AND step % 15 <> 0) AS BIGINT) AS n_odd_steps, max(step) AS max_gap_min,
  CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 6e7 / 15) + 1 AS BIGINT) AS expected_points,
  CAST(greatest(floor(date_diff('microsecond', min(ts), max(ts)) / 6e7 / 15) + 1 - sum(copies), 0) AS BIGINT) AS missing_points,
  round(100.0 * greatest(floor(date_diff('microsecond', min(ts), max(ts)) / 6e7 / 15) + 1 - sum(copies), 0) / (floor(date_diff('microsecond', min(ts), max(ts)) / 6e7 / 15) + 1), 6) AS pct_missing
FROM s GROUP BY strip, location"""


@query("DQ-02", CONT)
def dq_02(spark, sf):
    return dq.continuity(coarse(spark, sf), LOGGER).withColumn("pct_missing", r6(F.col("pct_missing")))


@query("DQ-02:worst", f"SELECT * FROM ({CONT}) ORDER BY pct_missing DESC, strip, location LIMIT 5")
def dq_02_worst(spark, sf):
    return dq.worst(dq_02(spark, sf), "pct_missing", 5, LOGGER)


@query("DQ-03", LAGGED + """ SELECT strip, location, CAST(sum(copies) AS BIGINT) AS n, CAST(count(*) FILTER (step > 30.5) AS BIGINT) AS gaps, CAST(sum(copies - 1) AS BIGINT) AS dupes,
  CASE WHEN sum(copies - 1) > 0 THEN 0.0 ELSE min(step) END AS min_step_min, max(step) AS max_step_min FROM s GROUP BY strip, location""")
def dq_03(spark, sf):
    return dq.cadence(coarse(spark, sf), LOGGER, 30.0)


SHUFFLED = f"""{READINGS}, files AS (SELECT strip, location, row_no, time_bucket(INTERVAL 15 MINUTE, ts) + to_minutes(CASE WHEN row_no % 17 = 0 THEN -90 WHEN row_no % 23 = 0 THEN 75 ELSE 0 END) AS ts FROM readings),
fl AS (SELECT *, lag(ts) OVER (PARTITION BY strip, location ORDER BY row_no) AS prev_ts FROM files), fs AS (SELECT *, {STEP} AS step FROM fl)"""


def files(spark, sf):
    """Logger files whose clock jumps: some rows are 90 minutes early, some 75 late."""
    k = F.col("row_no")
    move = F.when(k % 17 == 0, -90).when(k % 23 == 0, 75).otherwise(0) * 60
    return readings(spark, sf).select("strip", "location", "row_no", shift(floor_to("ts", 900), move).alias("ts"))


@query("DQ-04", f"""WITH {SHUFFLED}, m AS (SELECT strip, location, median(step) FILTER (step > 0) AS med, count(*) AS n FROM fs GROUP BY ALL),
d AS (SELECT strip, location, sum(c - 1) AS n_duplicates FROM (SELECT strip, location, ts, count(*) AS c FROM files GROUP BY ALL) GROUP BY ALL)
SELECT strip, location, CAST(any_value(n) AS BIGINT) AS n_rows, any_value(med) AS inferred_step_min, CAST(count(*) FILTER (step < 0) AS BIGINT) AS n_nonmonotonic,
  CAST(count(*) FILTER (step > 3 * med) AS BIGINT) AS n_large_gaps, max(step) FILTER (step > 3 * med) AS largest_gap_min, CAST(any_value(n_duplicates) AS BIGINT) AS n_duplicates
FROM fs JOIN m USING (strip, location) JOIN d USING (strip, location) GROUP BY strip, location""")
def dq_04(spark, sf):
    return dq.time_health(files(spark, sf), LOGGER)


@query("DQ-05", f"""WITH {READINGS}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, max(CASE variable WHEN 'VWC' THEN value END) AS VWC, max(CASE variable WHEN 'T' THEN value END) AS T,
  max(CASE variable WHEN 'EC' THEN value END) AS EC, max(CASE variable WHEN 'BattV_Min' THEN value END) AS BattV_Min, max(CASE variable WHEN 'precip' THEN value END) AS precip FROM readings GROUP BY 1, strip, location),
c AS (SELECT 'VWC' AS "column", count(*) - count(VWC) AS n, count(*) AS t FROM w UNION ALL SELECT 'T', count(*) - count(T), count(*) FROM w UNION ALL SELECT 'EC', count(*) - count(EC), count(*) FROM w
  UNION ALL SELECT 'BattV_Min', count(*) - count(BattV_Min), count(*) FROM w UNION ALL SELECT 'precip', count(*) - count(precip), count(*) FROM w)
SELECT "column", CAST(n AS BIGINT) AS nan_count, round(n / t, 6) AS nan_fraction FROM c""")
def dq_05(spark, sf):
    names = ["VWC", "T", "EC", "BattV_Min", "precip"]
    wide = readings(spark, sf).groupBy(floor_to("ts", 3600).alias("bin"), *LOGGER).agg(
        *[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])
    return dq.missingness(wide, names).withColumn("nan_fraction", r6(F.col("nan_fraction")))


def volts(spark, sf):
    return readings(spark, sf).filter("variable = 'BattV_Min'")


VOLTS = f"{READINGS}, volts AS (SELECT * FROM readings WHERE variable = 'BattV_Min')"


@query("DQ-06", f"""WITH {VOLTS} SELECT strip, location, CAST(count(value) AS BIGINT) AS n, min(value) AS min_v, max(value) AS max_v, CAST(count(*) FILTER (value < 11 OR value > 13) AS BIGINT) AS out_of_range_count,
  round(avg(CASE WHEN value < 11 OR value > 13 THEN 1.0 ELSE 0.0 END), 6) AS out_of_range_fraction, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99
FROM volts GROUP BY strip, location""")
def dq_06(spark, sf):
    return dq.battery_health(volts(spark, sf), LOGGER).withColumns({c: r6(F.col(c)) for c in ("out_of_range_fraction", "p01", "p50", "p99")})


@query("DQ-06:violations", f"""WITH {VOLTS} SELECT strip, location, ts, value, CASE WHEN value < 11 THEN 'below_min' ELSE 'above_max' END AS reason FROM volts WHERE value < 11 OR value > 13""")
def dq_06_violations(spark, sf):
    return dq.battery_violations(volts(spark, sf), LOGGER, ["ts", "row_no"]).select(*LOGGER, "ts", "value", "reason")


@query("DQ-07", f"""WITH {VOLTS}, y AS (SELECT *, CAST(year(ts) AS INTEGER) AS year FROM readings WHERE ts >= TIMESTAMP '2024-01-03'), t AS (SELECT year, count(DISTINCT ts) AS n_total FROM y GROUP BY year),
v AS (SELECT year, strip, location, ts, min(value) AS v FROM y WHERE variable = 'BattV_Min' AND location <> 'M' GROUP BY ALL), l AS (SELECT *, lag(ts) OVER (PARTITION BY year, strip, location ORDER BY ts) AS prev_ts FROM v),
a AS (SELECT year, strip, location, count(*) AS n, min(v) AS mv, max({STEP}) AS max_gap_min FROM l GROUP BY ALL)
SELECT year, strip, location, round_even(mv, 3) AS min_voltage, mv < 0.01 AS any_below_threshold, round_even(100.0 * (1 - n / n_total), 2) AS pct_missing, coalesce(max_gap_min <= 2000, false) AS continuous_record,
  max_gap_min, CASE WHEN NOT coalesce(max_gap_min <= 2000, false) THEN 'GAP' WHEN mv < 0.01 THEN 'LOW_VOLTAGE' ELSE 'GOOD' END AS status FROM a JOIN t USING (year)""")
def dq_07(spark, sf):
    rows = readings(spark, sf)
    known = (F.col("variable") == "BattV_Min") & (F.col("location") != "M")
    masked = rows.withColumn("value", F.when(known, F.col("value")))
    return dq.logger_health(masked, LOGGER, "2024-01-03", 0.01, 2000.0)


RAW_BAD = "CASE variable WHEN 'VWC' THEN value < 0 OR value > 1 WHEN 'T' THEN value < -50 OR value > 80 WHEN 'EC' THEN value < 0 OR value > 20 WHEN 'BattV_Min' THEN value < 0 OR value > 20 ELSE false END AND abs(value) < 200"


@query("DQ-08", f"WITH {READINGS} SELECT strip, location, depth, variable, CAST(count(*) AS BIGINT) AS violation_count, min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM readings WHERE {RAW_BAD} GROUP BY ALL")
def dq_08(spark, sf):
    bad = dq.range_violations(readings(spark, sf), sentinel=200.0)
    return dq.violation_summary(bad, ["strip", "location", "depth", "variable"])


def runs_sql(src: str, cond: str, part: str = "strip, location") -> str:
    return f"""(SELECT {part}, min(ts) AS start, max(ts) AS "end", count(*) AS n_points, min(value) AS min_value, max(value) AS max_value, arg_max(ts, value) AS max_ts FROM (
    SELECT *, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY ts, row_no ROWS UNBOUNDED PRECEDING) AS g FROM {src}) WHERE {cond} GROUP BY {part}, g)"""


@query("DQ-09", f'WITH {VOLTS} SELECT strip, location, start, "end", CAST(n_points AS BIGINT) AS n_points, min_value, max_value FROM {runs_sql("volts", "value < 9.6")}')
def dq_09(spark, sf):
    return dq.threshold_runs(volts(spark, sf), LOGGER, F.col("value") < 9.6, ["ts", "row_no"]).drop("max_ts")


STEPS = f"""days AS (SELECT strip, location, date_trunc('day', ts) AS day, min(value) AS daily_min FROM volts GROUP BY ALL),
ds AS (SELECT *, daily_min - lag(daily_min) OVER (PARTITION BY strip, location ORDER BY day) AS delta_v, count(*) OVER (PARTITION BY strip, location) AS n FROM days)"""


@query("DQ-10", f"WITH {VOLTS}, {STEPS} SELECT strip, location, day, daily_min, round(delta_v, 6) AS delta_v FROM ds WHERE delta_v >= 0.6 AND n >= 10")
def dq_10(spark, sf):
    return dq.daily_steps(volts(spark, sf), LOGGER).withColumn("delta_v", r6(F.col("delta_v")))


NUL = "CAST(NULL AS DOUBLE)"


@query("DQ-11", f"""WITH {VOLTS}, {STEPS}, gp AS (SELECT strip, location, ts, lag(ts) OVER (PARTITION BY strip, location ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT strip, location, ts FROM volts))
SELECT strip, location, 'gap' AS kind, 'info' AS severity, prev_ts AS start, ts AS "end", {NUL} AS min_v, {NUL} AS max_v, {STEP} AS gap_minutes, {NUL} AS delta_v FROM gp WHERE {STEP} >= 600
UNION ALL SELECT strip, location, 'brownout', 'warn', start, "end", min_value, {NUL}, {NUL}, {NUL} FROM {runs_sql("volts", "value < 9.6")}
UNION ALL SELECT strip, location, 'replacement_step', 'info', day, day, {NUL}, {NUL}, {NUL}, round(delta_v, 6) FROM ds WHERE delta_v >= 0.6 AND n >= 10
UNION ALL SELECT strip, location, 'high_voltage_warn', 'warn', start, "end", {NUL}, max_value, {NUL}, {NUL} FROM {runs_sql("volts", "value >= 16")}
UNION ALL SELECT strip, location, 'high_voltage_critical', 'critical', start, "end", {NUL}, max_value, {NUL}, {NUL} FROM {runs_sql("volts", "value >= 18")}""")
def dq_11(spark, sf):
    return dq.voltage_events(volts(spark, sf), LOGGER, ["ts", "row_no"], gap_minutes=600.0).withColumn("delta_v", r6(F.col("delta_v")))


VWC = f"{READINGS}, vwc AS (SELECT * FROM readings WHERE variable = 'VWC')"
SENSOR = ["strip", "location", "depth"]


def vwc(spark, sf):
    return readings(spark, sf).filter("variable = 'VWC'")


@query("DQ-12", f"""WITH {VWC}, l AS (SELECT *, lag(value) OVER (PARTITION BY strip, location, depth ORDER BY ts, row_no) AS p FROM vwc),
b AS (SELECT strip, location, depth, count(*) AS n_obs, max(value) AS max_value, arg_max(ts, value) AS max_ts, count(*) FILTER (value > 50) AS c50, count(*) FILTER (value > 55) AS c55, count(*) FILTER (value < 1) AS c1,
  count(*) FILTER (abs(value - p) > 10) AS cj, count(*) FILTER (value > 50 AND NOT coalesce(p > 50, false)) AS e50, count(*) FILTER (value > 55 AND NOT coalesce(p > 55, false)) AS e55, count(*) FILTER (value < 1 AND NOT coalesce(p < 1, false)) AS e1 FROM l GROUP BY ALL),
r50 AS (SELECT strip, location, depth, max(n_points) AS m FROM {runs_sql('vwc', 'value > 50', 'strip, location, depth')} GROUP BY ALL), r55 AS (SELECT strip, location, depth, max(n_points) AS m FROM {runs_sql('vwc', 'value > 55', 'strip, location, depth')} GROUP BY ALL)
SELECT strip, location, depth, CAST(n_obs AS BIGINT) AS n_obs, max_value, max_ts, CAST(c50 AS BIGINT) AS count_gt_50, CAST(c55 AS BIGINT) AS count_gt_55, CAST(c1 AS BIGINT) AS count_lt_1, CAST(cj AS BIGINT) AS count_large_jump,
  CAST(e50 AS BIGINT) AS episodes_gt_50, CAST(e55 AS BIGINT) AS episodes_gt_55, CAST(e1 AS BIGINT) AS episodes_lt_1, CAST(coalesce(r50.m, 0) AS BIGINT) AS longest_pts_gt_50, round_even(coalesce(r50.m, 0) / 4.0, 2) AS longest_hrs_gt_50,
  CAST(coalesce(r55.m, 0) AS BIGINT) AS longest_pts_gt_55, round_even(coalesce(r55.m, 0) / 4.0, 2) AS longest_hrs_gt_55 FROM b LEFT JOIN r50 USING (strip, location, depth) LEFT JOIN r55 USING (strip, location, depth)""".replace("/ 4.0", "/ 4.0::DOUBLE"))
def dq_12(spark, sf):
    return dq.sensor_qa(vwc(spark, sf), SENSOR, ["ts", "row_no"])


@query("DQ-13", f"""WITH {VWC} SELECT strip, location, depth, start, "end", CAST(n_points AS BIGINT) AS n_points, min_value, max_value, max_ts, n_points / 4.0::DOUBLE AS duration_hours FROM {runs_sql('vwc', 'value > 50', 'strip, location, depth')}""")
def dq_13(spark, sf):
    return dq.episodes(vwc(spark, sf), SENSOR, 50.0, ["ts", "row_no"])


@query("DQ-13:hours", f"WITH {VWC} SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(count(*) AS BIGINT) AS n FROM vwc WHERE value > 50 GROUP BY 1")
def dq_13_hours(spark, sf):
    return dq.by_hour(vwc(spark, sf), 50.0)


@query("DQ-14", f"WITH {ORDER_TIMES} SELECT row_no, ts, CAST(year(ts) AS INTEGER) AS year FROM order_times WHERE ts >= TIMESTAMP '1997-10-31 12:00:00' AND ts <= TIMESTAMP '1998-02-28 12:00:00'")
def dq_14(spark, sf):
    return dq.voltage_window(order_times(spark, sf), "1997-12-31 12:00:00", 2).select("row_no", "ts", "year")


@query("DQ-14:voltage", f"""WITH {READINGS} SELECT ts, strip, location, max(CASE variable WHEN 'BattV_Min' THEN value END) AS volts, CAST(year(ts) AS INTEGER) AS year FROM readings
  WHERE ts >= TIMESTAMP '2023-12-15 12:00:00' AND ts <= TIMESTAMP '2024-02-15 12:00:00' GROUP BY ALL HAVING count(*) FILTER (variable = 'BattV_Min' AND value IS NOT NULL) > 0""")
def dq_14_voltage(spark, sf):
    """The voltage column of a wide frame is found by its name."""
    names = ["VWC", "T", "EC", "BattV_Min", "precip"]
    wide = readings(spark, sf).groupBy("ts", *LOGGER).agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])
    column = dq.pick_voltage_column(wide.columns)
    out = dq.voltage_window(wide.filter(F.col(column).isNotNull()), "2024-01-15 12:00:00", 1)
    return out.select("ts", *LOGGER, F.col(column).alias("volts"), "year")


KIND = """CASE WHEN step BETWEEN 65 AND 95 THEN 'setclock_forward' WHEN step BETWEEN -95 AND -35 THEN 'setclock_backward' WHEN step = 0 THEN 'duplicate_timestamp' WHEN step < 0 AND abs(step) <= 30 THEN 'out_of_order'
  WHEN step < 0 THEN 'nonmonotonic' WHEN step >= 120 THEN 'downtime_gap' END"""
CLOCKED = f"""WITH {SHUFFLED}, ev AS (SELECT strip, location, row_no, prev_ts, ts, step, {KIND} AS event_type FROM fs WHERE {KIND} IS NOT NULL)"""


@query("CLK-01", CLOCKED + """ SELECT strip, location, row_no, prev_ts, ts, round_even(step, 3) AS gap_min, event_type, CASE WHEN event_type LIKE 'setclock%' THEN 'clock' WHEN event_type IN ('duplicate_timestamp', 'out_of_order') THEN 'order'
  WHEN event_type = 'nonmonotonic' THEN 'other' ELSE 'downtime' END AS event_class FROM ev""")
def clk_01(spark, sf):
    return ck.clock_events(files(spark, sf), LOGGER)


def dated(spark, sf):
    return files(spark, sf).withColumn("year", F.lit(2023) + F.floor(F.col("row_no") % 2).cast("int"))


DATED = SHUFFLED.split(", fl AS")[0] + f""", dated AS (SELECT *, CAST(2023 + row_no % 2 AS INTEGER) AS year FROM files),
dl AS (SELECT *, lag(ts) OVER (PARTITION BY strip, location, year ORDER BY row_no) AS prev_ts FROM dated), ds AS (SELECT *, {STEP} AS step FROM dl), ev AS (SELECT *, {KIND} AS k FROM ds WHERE {KIND} IS NOT NULL)"""


@query("CLK-02", f"""WITH {DATED}, n AS (SELECT strip, location, year, count(*) AS n_rows FROM dated GROUP BY ALL), st AS (SELECT *, lag(k) OVER (PARTITION BY strip, location, year ORDER BY row_no) AS pk FROM ev WHERE k LIKE 'setclock%'),
rp AS (SELECT strip, location, year, bool_or(pk = k AND k = 'setclock_forward') AS ff, bool_or(pk = k AND k = 'setclock_backward') AS bb FROM st GROUP BY ALL),
c AS (SELECT strip, location, year, count(*) FILTER (k = 'setclock_forward') AS f, count(*) FILTER (k = 'setclock_backward') AS b, count(*) FILTER (k = 'duplicate_timestamp') AS d, count(*) FILTER (k = 'out_of_order') AS o,
  count(*) FILTER (k IN ('duplicate_timestamp', 'out_of_order', 'nonmonotonic')) AS nm, count(*) FILTER (k = 'downtime_gap') AS dg, arg_min(ts, row_no) FILTER (k = 'setclock_forward') AS ft, arg_min(ts, row_no) FILTER (k = 'setclock_backward') AS bt,
  arg_min(ts, row_no) FILTER (k = 'out_of_order') AS ot FROM ev GROUP BY ALL),
z AS (SELECT strip, location, year, n_rows, coalesce(f, 0) AS f, coalesce(b, 0) AS b, coalesce(d, 0) AS d, coalesce(o, 0) AS o, coalesce(nm, 0) AS nm, coalesce(dg, 0) AS dg, ft, bt, ot, coalesce(ff, false) AS ff, coalesce(bb, false) AS bb
  FROM n LEFT JOIN c USING (strip, location, year) LEFT JOIN rp USING (strip, location, year)),
q AS (SELECT *, concat_ws('; ', CASE WHEN year = 2023 AND f > 0 THEN '2023 has forward setclock event(s)' END, CASE WHEN ff THEN 'consecutive forward setclock events (FF)' END, CASE WHEN bb THEN 'consecutive backward setclock events (BB)' END,
  CASE WHEN o > 0 THEN 'out_of_order events=' || o END) AS reasons FROM z)
SELECT strip, location, year, CAST(n_rows AS BIGINT) AS n_rows, CAST(f AS BIGINT) AS forward_setclock, CAST(b AS BIGINT) AS backward_setclock, CAST(d AS BIGINT) AS duplicate_timestamps, CAST(o AS BIGINT) AS out_of_order, CAST(nm AS BIGINT) AS nonmonotonic_events,
  CAST(dg AS BIGINT) AS downtime_gaps, ft AS first_forward_time, bt AS first_backward_time, ot AS first_out_of_order_time, ff AS "has_FF", bb AS "has_BB", reasons, CASE WHEN reasons = '' THEN 'likely_explained' ELSE 'needs_research' END AS classification FROM q""")
def clk_02(spark, sf):
    return ck.clock_summary(dated(spark, sf), ["strip", "location", "year"])


TIMELINE = f"""WITH {DATED}, n AS (SELECT strip, location, year FROM dated GROUP BY ALL HAVING count(*) >= 3), x AS (SELECT strip || location AS logger, year, row_no, ts, step FROM ds JOIN n USING (strip, location, year)),
e AS (SELECT *, 'DUPLICATE' AS event_type, 0 AS delta, 0 AS place FROM x WHERE step = 0 UNION ALL SELECT *, 'DOWNTIME', 0, 1 FROM x WHERE step >= 120 UNION ALL SELECT *, 'FORWARD_SET_CLOCK', 60, 2 FROM x WHERE step BETWEEN 65 AND 95
  UNION ALL SELECT *, 'BACKWARD_SET_CLOCK', -60, 3 FROM x WHERE step BETWEEN -95 AND -35 UNION ALL SELECT *, 'NONMONOTONIC', 0, 4 FROM x WHERE step < 0 AND NOT step BETWEEN -95 AND -35),
o AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY logger ORDER BY year, row_no, place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off FROM e)"""
MODE = "CASE WHEN (({0} % 120) + 120) % 120 = 0 THEN 'MDT' WHEN (({0} % 120) + 120) % 120 = 60 THEN 'MST' ELSE 'SHIFTED(' || {0} || 'min)' END"


def logged(spark, sf):
    return dated(spark, sf).select(F.concat("strip", "location").alias("logger"), "year", "row_no", "ts")


@query("CLK-03", TIMELINE + f" SELECT logger, year, row_no, ts AS event_time, step AS gap_min, event_type, delta AS normalized_delta_min, off AS cumulative_offset_min, {MODE.format('off')} AS implied_mode FROM o")
def clk_03(spark, sf):
    return ck.clock_offset_timeline(logged(spark, sf))


@query("CLK-03:years", TIMELINE + f""", y AS (SELECT DISTINCT logger, year FROM (SELECT strip || location AS logger, year FROM dated)), d AS (SELECT logger, year, sum(delta) AS d, count(*) FILTER (event_type LIKE 'FORWARD%') AS f, count(*) FILTER (event_type LIKE 'BACKWARD%') AS b FROM o GROUP BY ALL),
w AS (SELECT logger, year, coalesce(d, 0) AS d, coalesce(f, 0) AS f, coalesce(b, 0) AS b, CAST(sum(coalesce(d, 0)) OVER (PARTITION BY logger ORDER BY year) AS BIGINT) AS e FROM y LEFT JOIN d USING (logger, year)), v AS (SELECT *, CAST(e - d AS BIGINT) AS s FROM w)
SELECT logger, year, s AS start_offset_min, {MODE.format('s')} AS start_mode, e AS end_offset_min, {MODE.format('e')} AS end_mode, CAST(f AS BIGINT) AS forward_setclock, CAST(b AS BIGINT) AS backward_setclock FROM v""")
def clk_03_years(spark, sf):
    rows = logged(spark, sf)
    return ck.offset_by_year(ck.clock_offset_timeline(rows), rows)


@query("CLK-04", f"""WITH {SHUFFLED}, n AS (SELECT strip, location FROM files GROUP BY ALL HAVING count(*) >= 3)
SELECT strip, location, CASE WHEN step > 55 THEN 'forward' ELSE 'backward' END AS kind, prev_ts, ts, step AS gap_min FROM fs JOIN n USING (strip, location) WHERE step > 55 OR step < -40""")
def clk_04(spark, sf):
    return ck.jump_events(files(spark, sf), LOGGER)


def stations(spark, sf):
    """Orders as loggers on an hourly grid over years: the priority digit is the logger; two of them
    never follow daylight time."""
    rows = order_times(spark, sf).select(
        F.concat(F.lit("L"), F.substring("variable", 1, 1)).alias("logger"), "row_no", floor_to("ts", 4 * 3600).alias("ts"))
    return rows.withColumn("year", F.year("ts"))


def _spans(spark, sf):
    return dst_transitions(stations(spark, sf).select("year"))


OVERLAP = f"""WITH {ORDER_TIMES}, {US_RULE}, st AS (SELECT 'L' || substr(variable, 1, 1) AS logger, row_no, time_bucket(INTERVAL 4 HOUR, ts) AS ts, CAST(year(time_bucket(INTERVAL 4 HOUR, ts)) AS INTEGER) AS year FROM order_times),
nn AS (SELECT year, logger, count(*) AS n FROM st GROUP BY ALL), rf AS (SELECT year, logger AS ref_logger FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, logger) AS k FROM nn) WHERE k = 1),
p AS (SELECT DISTINCT year, logger, ts FROM st), q AS (SELECT p.*, ts >= spring + to_hours(3) AND ts < autumn + to_hours(1) AS summer FROM p JOIN edges USING (year)),
cp AS (SELECT DISTINCT year, logger, v, t FROM (SELECT year, logger, 'base' AS v, ts AS t FROM q UNION ALL SELECT year, logger, 'mst', CASE WHEN summer THEN ts ELSE ts - to_hours(1) END FROM q UNION ALL SELECT year, logger, 'mdt', CASE WHEN summer THEN ts + to_hours(1) ELSE ts END FROM q)),
rp AS (SELECT p.year, p.ts FROM p JOIN rf ON p.year = rf.year AND p.logger = rf.ref_logger), h AS (SELECT cp.year, cp.logger, count(*) FILTER (v = 'base' AND rp.ts IS NOT NULL) AS b, count(*) FILTER (v = 'mst' AND rp.ts IS NOT NULL) AS m, count(*) FILTER (v = 'mdt' AND rp.ts IS NOT NULL) AS d
  FROM cp LEFT JOIN rp ON cp.year = rp.year AND cp.t = rp.ts GROUP BY ALL), tt AS (SELECT year, logger, count(*) AS n FROM p GROUP BY ALL),
ov AS (SELECT year, logger, ref_logger, b / n AS b, m / n AS m, d / n AS d FROM h JOIN tt USING (year, logger) JOIN rf USING (year))"""


@query("CLK-05", OVERLAP + """ SELECT year, logger, ref_logger, round(b, 6) AS base_overlap, round(m, 6) AS overlap_shift_mst_minus1h, round(d, 6) AS overlap_shift_mdt_plus1h, round(m - b, 6) AS delta_mst_minus1h, round(d - b, 6) AS delta_mdt_plus1h FROM ov""")
def clk_05(spark, sf):
    rows = stations(spark, sf)
    out = ck.overlap_test(rows, ck.reference_logger(rows), _spans(spark, sf))
    names = ("base_overlap", "overlap_shift_mst_minus1h", "overlap_shift_mdt_plus1h", "delta_mst_minus1h", "delta_mdt_plus1h")
    return out.withColumns({c: r6(F.col(c)) for c in names})


@query("CLK-06", OVERLAP + f""", fl AS (SELECT year, logger, ts, lag(ts) OVER (PARTITION BY year, logger ORDER BY row_no) AS prev_ts FROM st), js AS (SELECT year, logger, ts, {STEP} AS step FROM fl),
jc AS (SELECT year, logger, count(*) FILTER (step > 55 AND step BETWEEN 40 AND 120) AS f, count(*) FILTER (step < -40 AND step BETWEEN -120 AND -40) AS k, min(ts) FILTER (step > 55 AND step <= 120) AS fat FROM js GROUP BY ALL),
z AS (SELECT ov.*, f, k, fat, spring + to_hours(3) AS dst FROM ov JOIN jc USING (year, logger) JOIN edges USING (year))
SELECT year, logger, ref_logger, CASE WHEN f + k >= 3 THEN 'irregular_manual' WHEN f = 1 AND k = 0 AND fat >= dst AND fat <= dst + to_days(200) THEN 'seasonal_manual' WHEN m - b >= 0.1 AND m > d THEN 'always_mdt' WHEN d - b >= 0.1 AND d > m THEN 'always_mst' ELSE 'unknown' END AS mode,
  CAST(f AS BIGINT) AS n_forward, CAST(k AS BIGINT) AS n_backward, round(b, 6) AS base_overlap, round(m - b, 6) AS delta_mst_minus1h, round(d - b, 6) AS delta_mdt_plus1h FROM z""")
def clk_06(spark, sf):
    out = ck.clock_mode(stations(spark, sf), _spans(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("base_overlap", "delta_mst_minus1h", "delta_mdt_plus1h")})


# ------------------------------------------------------------------ batteries

PRE = f"""{READINGS}, once AS (SELECT strip, ts, min(value) AS value FROM readings GROUP BY ALL), pre AS (SELECT strip, CAST(ts AS DATE) AS date, make_timestamp(CAST(floor(quantile_cont(epoch_us(ts), 0.5)) AS BIGINT)) AS time, median(value) AS value
  FROM once WHERE abs(hour(ts) * 60 + minute(ts) - 300) <= 20 GROUP BY ALL)"""


def pre(spark, sf):
    return bt.predawn(readings(spark, sf), ["strip"])


@query("BAT-01", f"WITH {PRE} SELECT strip, date, time, round(value, 6) AS value FROM pre")
def bat_01(spark, sf):
    return pre(spark, sf).withColumn("value", r6(F.col("value")))


ISLAND = """good AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY strip ORDER BY date) AS INTEGER) AS island FROM pre WHERE value >= 12),
sk AS (SELECT *, row_number() OVER (PARTITION BY strip, island ORDER BY date DESC) AS streak FROM good)"""


@query("BAT-02", f"""WITH {PRE}, {ISLAND}, l AS (SELECT *, lag(time) OVER w AS prev_time, lag(value) OVER w AS prev_v FROM pre WINDOW w AS (PARTITION BY strip ORDER BY date))
SELECT l.strip, prev_time, l.time, round(prev_v, 6) AS prev_v, round(l.value, 6) AS v, round(l.value - prev_v, 6) AS delta_v, CAST(streak AS INTEGER) AS stable_streak_days FROM l JOIN sk ON l.strip = sk.strip AND l.date = sk.date WHERE l.value - prev_v >= 0.6 AND streak >= 2""")
def bat_02(spark, sf):
    out = bt.replacement_steps(pre(spark, sf), ["strip"], stable_days=2)
    return out.withColumns({c: r6(F.col(c)) for c in ("prev_v", "v", "delta_v")})


@query("BAT-03", f"WITH {PRE}, {ISLAND} SELECT strip, min(time) AS start_time, max(time) AS end_time, CAST(count(*) AS BIGINT) AS n_days FROM good GROUP BY strip, island HAVING count(*) >= 3")
def bat_03(spark, sf):
    return bt.good_streaks(pre(spark, sf), ["strip"], min_days=3)


def intervals(spark, sf, stride=1):
    """Supplier service intervals from one ship date to the next; some run long, some are open."""
    ship = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("install_date")).distinct()
    from ..plans import lag_in_time

    return lag_in_time(ship, ["l_suppkey"], ["install_date"], {"install_date": "end_date"}, 30 * 86400, lead=True)


INTERVALS = """iv AS (SELECT l_suppkey, install_date, lead(install_date) OVER (PARTITION BY l_suppkey ORDER BY install_date) AS end_date FROM (SELECT DISTINCT l_suppkey, l_shipdate AS install_date FROM lineitem))"""


@query("BAT-04", f"""WITH {INTERVALS}, b AS (SELECT l_suppkey, install_date, CASE WHEN day(install_date) % 4 = 0 THEN NULL WHEN day(install_date) % 5 = 0 THEN end_date + to_days(9) ELSE end_date END AS end_date FROM iv),
p AS (SELECT *, last_value(end_date IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY install_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM b)
SELECT l_suppkey, install_date, end_date, prev_end FROM p WHERE install_date < prev_end""")
def bat_04(spark, sf):
    d = F.dayofmonth("install_date")
    end = F.col("end_date")
    rows = intervals(spark, sf).withColumn("end_date", F.when(d % 4 == 0, F.lit(None)).when(d % 5 == 0, shift(end, 9 * 86400)).otherwise(end))
    return bt.validate_intervals(rows, ["l_suppkey"])


@query("BAT-05", f"""WITH {INTERVALS}, o AS (SELECT o_orderkey, o_orderkey % 100 AS l_suppkey, o_orderdate AS ts FROM orders), k AS (SELECT l_suppkey, install_date, CASE WHEN day(install_date) % 5 = 0 THEN install_date + to_days(1) ELSE end_date END AS end_date, CAST(year(install_date) AS INTEGER) AS model FROM iv)
SELECT o.o_orderkey, o.l_suppkey, o.ts, k.install_date, k.model FROM o LEFT JOIN k ON k.l_suppkey = o.l_suppkey AND o.ts >= k.install_date AND (k.end_date IS NULL OR o.ts < k.end_date)""")
def bat_05(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("l_suppkey"), F.col("o_orderdate").alias("ts"))
    d = F.dayofmonth("install_date")
    rows = intervals(spark, sf).withColumns({"end_date": F.when(d % 5 == 0, shift("install_date", 86400)).otherwise(F.col("end_date")), "model": F.year("install_date")})
    return bt.active_at(orders, rows, ["l_suppkey"], ["model"], width=30 * 86400)


@query("BAT-06", f"""WITH {INTERVALS}, m AS (SELECT o_orderkey AS manual_no, o_orderkey % 100 AS l_suppkey, o_orderdate + to_hours(7) AS manual_date FROM orders),
pv AS (SELECT m.*, iv.install_date AS c, iv.end_date AS e FROM m ASOF LEFT JOIN iv ON m.l_suppkey = iv.l_suppkey AND m.manual_date >= iv.install_date), nx AS (SELECT m.manual_no, iv.install_date AS c, iv.end_date AS e FROM m ASOF LEFT JOIN iv ON m.l_suppkey = iv.l_suppkey AND m.manual_date < iv.install_date),
b AS (SELECT p.manual_no, p.l_suppkey, p.manual_date, CASE WHEN p.c IS NOT NULL AND (n.c IS NULL OR p.manual_date - p.c <= n.c - p.manual_date) THEN p.c ELSE n.c END AS c, CASE WHEN p.c IS NOT NULL AND (n.c IS NULL OR p.manual_date - p.c <= n.c - p.manual_date) THEN p.e ELSE n.e END AS e FROM pv p JOIN nx n USING (manual_no)),
w AS (SELECT *, CASE WHEN abs(date_diff('microsecond', c, manual_date)) <= 864000000000 THEN c END AS cc FROM b), k AS (SELECT *, cc IS NOT NULL AND row_number() OVER (PARTITION BY l_suppkey, cc ORDER BY manual_no) = 1 AS ok FROM w)
SELECT manual_no, l_suppkey, manual_date, ok AS matched_candidate, round(CASE WHEN ok THEN abs(date_diff('microsecond', c, manual_date)) / 8.64e10 END, 6) AS match_abs_days, CASE WHEN ok THEN cc END AS cand_time, CASE WHEN ok THEN e END AS cand_end_date FROM k""")
def bat_06(spark, sf):
    manual = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("manual_no"), (F.col("o_orderkey") % 100).alias("l_suppkey"), shift("o_orderdate", 7 * 3600).alias("manual_date"))
    cand = intervals(spark, sf).withColumnRenamed("install_date", "candidate_time")
    out = bt.match_nearest(manual, cand, ["l_suppkey"], ["end_date"])
    return out.withColumn("match_abs_days", r6(F.col("match_abs_days")))
