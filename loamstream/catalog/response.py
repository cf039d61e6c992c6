"""EVT-*: event response over purchases as irrigation and clicks as water content."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import events as ev
from ..plans.slices import shift
from ..session import cut_lineage
from .base import IRRIGATION, READINGS, irrigation, query, readings, table

AREA = 4293.33
GAL_IN = AREA / 12.0 * fv.GALLONS_PER_FT3_PROFILE


def r6(c):
    return F.round(c, 6)


def vwc(spark, sf):
    return readings(spark, sf)


GRID = READINGS + """, grid AS (SELECT strip, location, depth, variable, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM readings GROUP BY ALL),
volts AS (SELECT strip, location, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value, min(value) AS lo, max(value) AS hi, count(value) AS n,
  count(*) FILTER (value < 11) AS nl, count(*) FILTER (value > 13) AS nh FROM readings WHERE variable = 'BattV_Min' GROUP BY ALL)"""

JOINED = f"""WITH {GRID}, {IRRIGATION}, sensors AS (SELECT i.*, d.depth FROM irrigation i, (SELECT unnest(['1', '2', '3']) AS depth) d),
j AS (SELECT s.event_id, s.depth, s.start, r.ts, r.value FROM sensors s JOIN grid r ON r.strip = s.strip AND r.location = s.location AND r.depth = s.depth
  AND r.variable = 'VWC' AND r.ts >= s.start - to_hours(2) AND r.ts <= s.start + to_hours(40)),
bp AS (SELECT event_id, depth, any_value(start) AS start, median(value) FILTER (ts <= start) AS baseline_vwc, max(ts) FILTER (ts <= start) AS baseline_time,
  max(value) FILTER (ts >= start AND ts <= start + to_hours(24)) AS peak_vwc FROM j GROUP BY event_id, depth),
pk AS (SELECT bp.*, (SELECT min(j.ts) FROM j WHERE j.event_id = bp.event_id AND j.depth = bp.depth AND j.value = bp.peak_vwc AND j.ts >= bp.start AND j.ts <= bp.start + to_hours(24)) AS peak_time,
  peak_vwc - baseline_vwc AS peak_increase, peak_vwc IS NOT NULL AND (peak_vwc - baseline_vwc IS NULL OR peak_vwc - baseline_vwc >= 0.5) AS peak_found FROM bp)"""

PLATEAU = JOINED + """, a AS (SELECT j.event_id, j.depth, j.ts, j.value, pk.peak_time, row_number() OVER w AS rn,
    date_diff('microsecond', lag(j.ts) OVER w, j.ts) / 3.6e9 AS step, avg(j.value) OVER (PARTITION BY j.event_id, j.depth ORDER BY j.ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS sm
  FROM j JOIN pk ON j.event_id = pk.event_id AND j.depth = pk.depth WHERE pk.peak_found AND j.ts >= pk.peak_time AND j.ts <= pk.peak_time + to_hours(16)
  WINDOW w AS (PARTITION BY j.event_id, j.depth ORDER BY j.ts)),
b AS (SELECT *, median(step) OVER (PARTITION BY event_id, depth) AS step_h FROM a),
c AS (SELECT *, coalesce(abs((sm - lag(sm) OVER (PARTITION BY event_id, depth ORDER BY ts)) / CASE WHEN step_h > 0 THEN step_h END) <= 0.12, false) AS flat FROM b),
d AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY event_id, depth ORDER BY ts) AS run FROM c),
e AS (SELECT *, flat AND sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, depth, run) >= 4 AS ok FROM d),
f AS (SELECT *, min(CASE WHEN ok THEN rn END) OVER (PARTITION BY event_id, depth) AS f0, min(CASE WHEN ts >= peak_time + to_hours(4) THEN rn END) OVER (PARTITION BY event_id, depth) AS b0 FROM e),
g AS (SELECT event_id, depth, count(*) AS n, max(step_h) AS step_h, max(f0) AS f0, max(b0) AS b0,
  median(value) FILTER (rn >= f0 AND rn < f0 + 4) AS fv, min(ts) FILTER (rn >= f0 AND rn < f0 + 4) AS ft,
  median(value) FILTER (rn >= b0 AND rn < b0 + 4) AS bv, min(ts) FILTER (rn >= b0 AND rn < b0 + 4) AS bt FROM f GROUP BY event_id, depth),
m AS (SELECT pk.event_id, pk.depth, CASE WHEN NOT peak_found THEN 'no_peak' WHEN coalesce(n, 0) < 4 THEN 'insufficient_data' WHEN NOT coalesce(step_h > 0, false) THEN 'unknown_step'
  WHEN f0 IS NOT NULL THEN 'flat_segment' WHEN b0 IS NOT NULL THEN 'fallback_window' ELSE 'fallback_empty' END AS plateau_method, fv, ft, bv, bt
  FROM pk LEFT JOIN g ON pk.event_id = g.event_id AND pk.depth = g.depth),
pl AS (SELECT event_id, depth, plateau_method, CASE plateau_method WHEN 'flat_segment' THEN fv WHEN 'fallback_window' THEN bv END AS plateau_vwc,
  CASE plateau_method WHEN 'flat_segment' THEN ft WHEN 'fallback_window' THEN bt END AS plateau_time FROM m)"""

RESULTS = PLATEAU + """, res AS (SELECT s.event_id, s.strip, s.location, s.start, s."end", s.gallons_strip, s.year, s.depth, baseline_vwc, baseline_time, peak_vwc, peak_time, peak_increase,
  coalesce(peak_found, false) AS peak_found, coalesce(plateau_method, 'no_peak') AS plateau_method, plateau_vwc, plateau_time,
  date_diff('microsecond', s.start, peak_time) / 3.6e9 AS time_to_peak_hours, date_diff('microsecond', s.start, plateau_time) / 3.6e9 AS time_to_plateau_hours,
  date_diff('microsecond', s.start, s."end") / 3.6e9 AS event_duration_hours, s.gallons_strip / (date_diff('microsecond', s.start, s."end") / 3.6e9) AS avg_flow_gph_strip,
  'VWC_' || s.depth || '_raw_' || s.strip || '_' || s.location AS sensor_col
  FROM sensors s LEFT JOIN pk ON s.event_id = pk.event_id AND s.depth = pk.depth LEFT JOIN pl ON s.event_id = pl.event_id AND s.depth = pl.depth)"""


def joined(spark, sf, cfg=ev.EventConfig()):
    rows = ev.on_grid(vwc(spark, sf).filter("variable = 'VWC'"))
    spans = irrigation(spark, sf).select("event_id", "strip", "location", "start")
    return ev.window_join(spans, rows, cfg.baseline_hours, cfg.peak_hours + cfg.plateau_hours)


def measured(spark, sf, measure):
    """A measure of every (event, depth), worked out once for events that see the same rows of the grid."""
    return ev.measured_events(irrigation(spark, sf), ev.on_grid(vwc(spark, sf).filter("variable = 'VWC'")), measure)


def results(spark, sf):
    return ev.analyze_events(vwc(spark, sf), irrigation(spark, sf))


def derived(spark, sf):
    return ev.derive_event_fields(results(spark, sf))


def derived_once(spark, sf):
    """For reports that read the results several times: stored once in the shared folder.

    The results are events times depths, tiny next to the readings they come from.
    """
    return cut_lineage(derived(spark, sf))


@query("EVT-00", JOINED + " SELECT event_id, depth, ts, value FROM j")
def evt_00(spark, sf):
    return joined(spark, sf).select("event_id", "depth", "ts", "value")


@query("EVT-01", JOINED + " SELECT event_id, depth, round(baseline_vwc, 6) AS baseline_vwc, baseline_time FROM pk")
def evt_01(spark, sf):
    return measured(spark, sf, ev.baseline).withColumn("baseline_vwc", r6(F.col("baseline_vwc")))


@query("EVT-02", JOINED + " SELECT event_id, depth, round(peak_vwc, 6) AS peak_vwc, peak_time FROM pk")
def evt_02(spark, sf):
    return measured(spark, sf, ev.peak).withColumn("peak_vwc", r6(F.col("peak_vwc")))


@query("EVT-03", PLATEAU + " SELECT event_id, depth, plateau_method, plateau_time, round(plateau_vwc, 6) AS plateau_vwc FROM pl")
def evt_03(spark, sf):
    out = measured(spark, sf, ev.event_measures).select("event_id", "depth", "plateau_method", "plateau_time", "plateau_vwc")
    return out.withColumn("plateau_vwc", r6(F.col("plateau_vwc")))


ROW_NUMBERS = ("baseline_vwc", "peak_vwc", "peak_increase", "plateau_vwc", "time_to_peak_hours", "time_to_plateau_hours", "event_duration_hours", "avg_flow_gph_strip")


@query("EVT-04", RESULTS + " SELECT event_id, depth, sensor_col, peak_found, plateau_method, baseline_time, peak_time, plateau_time, " +
       ", ".join(f"round({c}, 6) AS {c}" for c in ROW_NUMBERS) + " FROM res")
def evt_04(spark, sf):
    out = results(spark, sf)
    return out.select("event_id", "depth", "sensor_col", "peak_found", "plateau_method", "baseline_time", "peak_time", "plateau_time",
                      *[r6(F.col(c)).alias(c) for c in ROW_NUMBERS])


STORE = f""", vol AS (SELECT strip, location, ts, sum(value / 100 * {fv.CYLINDER_GAL!r}) AS gal FROM grid WHERE variable = 'VWC' GROUP BY ALL),
st AS (SELECT res.*, b.gal AS b_gal, p.gal AS p_gal FROM res LEFT JOIN vol b ON b.strip = res.strip AND b.location = res.location AND b.ts = res.baseline_time
  LEFT JOIN vol p ON p.strip = res.strip AND p.location = res.location AND p.ts = res.plateau_time)"""


@query("EVT-05", RESULTS + STORE + """ SELECT event_id, depth, round(b_gal, 6) AS profile_baseline_storage_gal, round(p_gal, 6) AS profile_plateau_storage_gal,
  round(p_gal - b_gal, 6) AS event_storage_gal, round(CASE WHEN gallons_strip > 0 THEN (p_gal - b_gal) / gallons_strip END, 9) AS efficiency_strip,
  round(CASE WHEN gallons_strip > 0 THEN gallons_strip - (p_gal - b_gal) END, 6) AS estimated_loss_gal_strip FROM st""")
def evt_05(spark, sf):
    out = ev.storage_at(results(spark, sf), vwc(spark, sf))
    return out.select("event_id", "depth", r6("profile_baseline_storage_gal").alias("profile_baseline_storage_gal"),
                      r6("profile_plateau_storage_gal").alias("profile_plateau_storage_gal"), r6("event_storage_gal").alias("event_storage_gal"),
                      F.round("efficiency_strip", 9).alias("efficiency_strip"), r6("estimated_loss_gal_strip").alias("estimated_loss_gal_strip"))


PROFILE = f""", pr AS (SELECT event_id, coalesce(sum(baseline_vwc / 100 * 6), 0) AS b_in, coalesce(sum(plateau_vwc / 100 * 6), 0) AS p_in,
  coalesce(sum(plateau_vwc / 100 * 6 - baseline_vwc / 100 * 6), 0) AS e_in, count(plateau_vwc - baseline_vwc) AS n, max(gallons_strip) AS g FROM res GROUP BY event_id),
full_ AS (SELECT res.*, b_in AS profile_baseline_storage_in, p_in AS profile_plateau_storage_in, e_in AS event_storage_in, n AS n_profile_depths_used, {AREA}e0 AS profile_area_sqft,
  b_in * {GAL_IN!r} AS profile_baseline_storage_gal, p_in * {GAL_IN!r} AS profile_plateau_storage_gal, e_in * {GAL_IN!r} AS event_storage_gal,
  e_in * {GAL_IN!r} / CASE WHEN g > 0 THEN g END AS efficiency_strip, g - e_in * {GAL_IN!r} AS estimated_loss_gal_strip,
  CAST(res.depth AS INTEGER) * 6 AS depth_inches, time_to_peak_hours AS bottom_response_delay_hr, time_to_plateau_hours - event_duration_hours AS lag_after_irrigation_hr,
  CASE WHEN strip IN ('S1', 'S2') THEN 'S1_S2' ELSE 'S3_S4' END AS strip_group FROM res JOIN pr USING (event_id))"""

PROFILE_COLS = ("profile_baseline_storage_in", "profile_plateau_storage_in", "event_storage_in", "profile_baseline_storage_gal",
                "profile_plateau_storage_gal", "event_storage_gal", "estimated_loss_gal_strip")


def full(spark, sf, rows=None):
    group = F.when(F.col("strip").isin("S1", "S2"), "S1_S2").otherwise("S3_S4")
    rows = rows if rows is not None else derived(spark, sf)
    return ev.profile_storage(rows, AREA).withColumn("strip_group", group)


@query("EVT-06", RESULTS + PROFILE + " SELECT event_id, depth, CAST(n_profile_depths_used AS BIGINT) AS n_profile_depths_used, round(efficiency_strip, 9) AS efficiency_strip, " +
       ", ".join(f"round({c}, 5) AS {c}" for c in PROFILE_COLS) + " FROM full_")
def evt_06(spark, sf):
    return full(spark, sf, derived_once(spark, sf)).select("event_id", "depth", "n_profile_depths_used", F.round("efficiency_strip", 9).alias("efficiency_strip"),
                                  *[F.round(c, 5).alias(c) for c in PROFILE_COLS])


@query("EVT-07", RESULTS + PROFILE + """ SELECT event_id, depth, depth_inches, round(bottom_response_delay_hr, 6) AS bottom_response_delay_hr,
  round(lag_after_irrigation_hr, 6) AS lag_after_irrigation_hr, round(avg_flow_gph_strip, 6) AS avg_flow_gph_strip FROM full_""")
def evt_07(spark, sf):
    cols = ("bottom_response_delay_hr", "lag_after_irrigation_hr", "avg_flow_gph_strip")
    return derived(spark, sf).select("event_id", "depth", "depth_inches", *[r6(F.col(c)).alias(c) for c in cols])


@query("EVT-08", f"""WITH {IRRIGATION}, meta AS (SELECT event_id, start, "end", strip, CASE WHEN event_id % 3 = 0 THEN '' ELSE CASE WHEN strip IN ('S1', 'S2') THEN 'S1_S2' ELSE 'S3_S4' END END AS strip_group FROM irrigation)
SELECT i.event_id, i.strip, coalesce(nullif(m.strip_group, ''), s.strip_group) AS strip_group FROM irrigation i LEFT JOIN meta m ON i.event_id = m.event_id AND i.event_id % 2 = 0
LEFT JOIN (SELECT start, "end", min(strip_group) AS strip_group FROM (SELECT * FROM meta WHERE event_id % 2 = 0 UNION ALL SELECT event_id, start, "end", strip, 'late' FROM meta WHERE event_id % 5 = 0) GROUP BY ALL) s
  ON i.start = s.start AND i."end" = s."end" """)
def evt_08(spark, sf):
    """Half of the events are found by id, some only by their interval, some not at all."""
    irr = irrigation(spark, sf)
    group = F.when(F.col("strip").isin("S1", "S2"), "S1_S2").otherwise("S3_S4")
    meta = irr.withColumn("strip_group", F.when(F.col("event_id") % 3 == 0, "").otherwise(group))
    known = meta.filter("event_id % 2 = 0")
    late = meta.filter("event_id % 5 = 0").withColumn("strip_group", F.lit("late")).withColumn("event_id", -F.col("event_id") - 1)
    return ev.attach_meta(irr, known.unionByName(late)).select("event_id", "strip", "strip_group")


TARGET_SQL = """ SELECT {keys}, CAST(count(*) AS BIGINT) AS n_events, round(avg(plateau_vwc), 6) AS mean_value, round(coalesce(stddev_samp(plateau_vwc), 0), 6) AS sd_value,
  round(avg(plateau_vwc) + 0.5 * coalesce(stddev_samp(plateau_vwc), 0), 6) AS raw_target_value, round(quantile_cont(plateau_vwc, 0.95), 6) AS quantile_cap,
  round(least(avg(plateau_vwc) + 0.5 * coalesce(stddev_samp(plateau_vwc), 0), quantile_cont(plateau_vwc, 0.95)), 6) AS target_value, count(*) >= 3 AS target_is_trustworthy
FROM full_ WHERE plateau_vwc IS NOT NULL GROUP BY {keys}"""


@query("EVT-09", RESULTS + PROFILE + TARGET_SQL.format(keys="strip, depth_inches"))
def evt_09(spark, sf):
    out = ev.statistical_target(derived_once(spark, sf), ["strip", "depth_inches"])
    cols = ("mean_value", "sd_value", "raw_target_value", "quantile_cap", "target_value")
    return out.withColumns({c: r6(F.col(c)) for c in cols})


@query("EVT-10", RESULTS + PROFILE + """ SELECT strip, depth_inches, CAST(count(*) AS BIGINT) AS n_events, round(quantile_cont(time_to_plateau_hours, 0.75), 6) AS runtime_hours,
  round(quantile_cont(time_to_plateau_hours, 0.75) * 60, 6) AS runtime_minutes, count(*) >= 3 AS runtime_is_trustworthy FROM full_ WHERE time_to_plateau_hours IS NOT NULL GROUP BY strip, depth_inches""")
def evt_10(spark, sf):
    out = ev.recommend_runtime(derived_once(spark, sf), ["strip", "depth_inches"], "p75")
    return out.withColumns({c: r6(F.col(c)) for c in ("runtime_hours", "runtime_minutes")})


@query("EVT-11", RESULTS + PROFILE + """ SELECT strip, sensor_col, depth, depth_inches, CAST(nullif(count(plateau_vwc), 0) AS BIGINT) AS n_events_target,
  round_even(least(avg(plateau_vwc) + 0.5 * coalesce(stddev_samp(plateau_vwc), CASE WHEN count(plateau_vwc) > 0 THEN 0 END), quantile_cont(plateau_vwc, 0.95)), 6) AS target_vwc,
  CASE WHEN count(plateau_vwc) > 0 THEN count(plateau_vwc) >= 3 END AS target_is_trustworthy, CAST(nullif(count(time_to_plateau_hours), 0) AS BIGINT) AS n_events_runtime,
  round_even(median(time_to_plateau_hours), 6) AS runtime_hours, round_even(median(time_to_plateau_hours) * 60, 6) AS runtime_minutes,
  CASE WHEN count(time_to_plateau_hours) > 0 THEN count(time_to_plateau_hours) >= 3 END AS runtime_is_trustworthy,
  round_even(median(event_duration_hours), 6) AS median_irrigation_duration_hours, round_even(median(lag_after_irrigation_hr), 6) AS median_lag_after_irrigation_hr,
  round_even(median(avg_flow_gph_strip), 6) AS median_avg_flow_gph_strip FROM full_ GROUP BY strip, sensor_col, depth, depth_inches
HAVING count(plateau_vwc) > 0 OR count(time_to_plateau_hours) > 0""")
def evt_11(spark, sf):
    return ev.target_runtime_summary(derived_once(spark, sf))


@query("EVT-12", RESULTS + PROFILE + """ SELECT strip, depth_inches, CAST(count(time_to_plateau_hours) AS BIGINT) AS n_events, round_even(median(time_to_plateau_hours), 6) AS rec_runtime_hours,
  round_even(median(time_to_plateau_hours) * 60, 6) AS rec_runtime_minutes, count(time_to_plateau_hours) >= 3 AS rec_runtime_is_trustworthy,
  round_even(median(event_duration_hours), 6) AS actual_runtime_hours, round_even(median(event_duration_hours) * 60, 6) AS actual_runtime_minutes,
  round_even(median(avg_flow_gph_strip), 6) AS median_avg_flow_gph_strip, round_even(median(lag_after_irrigation_hr), 6) AS median_lag_after_irrigation_hr
FROM full_ GROUP BY strip, depth_inches HAVING count(time_to_plateau_hours) > 0""")
def evt_12(spark, sf):
    return ev.runtime_table(derived_once(spark, sf))


def batt_sql(a: str, b: str, p: str) -> str:
    return f"""(SELECT i.event_id, min(lo) AS {p}min_v, median(value) AS {p}median_v, max(hi) AS {p}max_v, sum(nl) AS {p}low_count, sum(nh) AS {p}high_count,
  sum(nl + nh) AS {p}out_of_range_count, sum(nl + nh) / sum(n) AS {p}out_of_range_fraction
  FROM irrigation i JOIN volts r ON r.strip = i.strip AND r.location = i.location AND r.ts >= {a} AND r.ts <= {b} GROUP BY i.event_id)"""


@query("EVT-13", f"""WITH {GRID}, {IRRIGATION} SELECT i.event_id, round(battery_min_v, 6) AS battery_min_v, round(battery_median_v, 6) AS battery_median_v, round(battery_max_v, 6) AS battery_max_v,
  CAST(battery_low_count AS BIGINT) AS battery_low_count, CAST(battery_high_count AS BIGINT) AS battery_high_count, CAST(battery_out_of_range_count AS BIGINT) AS battery_out_of_range_count,
  round(battery_out_of_range_fraction, 6) AS battery_out_of_range_fraction, coalesce(battery_low_count > 0, false) AS flag_battery_low, coalesce(battery_out_of_range_count > 0, false) AS flag_battery_out_of_range
FROM irrigation i LEFT JOIN {batt_sql('i.start', 'i."end"', 'battery_')} b USING (event_id)""")
def evt_13(spark, sf):
    out = ev.battery_window(vwc(spark, sf), irrigation(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("battery_min_v", "battery_median_v", "battery_max_v", "battery_out_of_range_fraction")})


def gappy(spark, sf):
    """Readings in which every fifth water content is missing."""
    return readings(spark, sf).withColumn("value", F.when((F.col("variable") == "VWC") & (F.col("row_no") % 5 == 0), F.lit(None)).otherwise(F.col("value")))


def rain(spark, sf):
    return readings(spark, sf).filter("variable = 'precip'").select("ts", (F.col("value") / 2100).alias("precip_in"))


def flags(spark, sf):
    sensors = irrigation(spark, sf).withColumn("depth", F.explode(F.array(*[F.lit(d) for d in "123"])))
    return ev.pre_start_flags(gappy(spark, sf), rain(spark, sf), sensors)


SENSORS = "sensors AS (SELECT i.*, d.depth FROM irrigation i, (SELECT unnest(['1', '2', '3']) AS depth) d)"
FLAG_PARTS = f"""wet15 AS (SELECT strip, location, depth, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(CASE WHEN row_no % 5 <> 0 THEN value END) AS value FROM readings WHERE variable = 'VWC' GROUP BY ALL),
rain15 AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(value / 2100) AS precip FROM readings WHERE variable = 'precip' GROUP BY ALL),
w AS (SELECT s.event_id, s.depth, r.ts, r.value FROM sensors s JOIN wet15 r ON r.strip = s.strip AND r.location = s.location AND r.depth = s.depth
  AND r.ts >= s.start - to_hours(6) AND r.ts <= s.start),
p AS (SELECT event_id, depth, arg_min(value, ts) FILTER (value IS NOT NULL) AS first_vwc, arg_max(value, ts) FILTER (value IS NOT NULL) AS last_vwc, max(value) AS max_vwc,
  arg_max(ts, value) FILTER (value IS NOT NULL) AS max_time, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM w GROUP BY ALL HAVING count(value) >= 2),
rn AS (SELECT i.event_id, sum(r.precip) AS total, max(r.precip) AS top, min(r.ts) FILTER (r.precip > 0) AS t0, max(r.ts) FILTER (r.precip > 0) AS t1 FROM irrigation i
  JOIN rain15 r ON r.ts >= i.start - to_hours(6) AND r.ts <= i.start GROUP BY ALL),
z AS (SELECT s.event_id, s.depth, s.strip, s.location, s.gallons_strip, s.start, s."end", first_vwc, last_vwc, max_vwc, max_time, missing, coalesce(total, 0) AS total, coalesce(top, 0) AS top, t0, t1,
  a.a_min_v, b.b_min_v, coalesce(a.a_out_of_range_count > 0, false) OR coalesce(b.b_out_of_range_count > 0, false) OR missing > 0.25 AS suspect, max_vwc - first_vwc >= 0.5 AS responded, coalesce(total, 0) >= 0.01 AS rained
  FROM sensors s JOIN p USING (event_id, depth) LEFT JOIN rn USING (event_id) LEFT JOIN {batt_sql('i.start - to_hours(6)', 'i.start', 'a_')} a USING (event_id) LEFT JOIN {batt_sql('i.start', 'i."end"', 'b_')} b USING (event_id))"""
FLAGS = f"WITH {GRID}, {IRRIGATION}, {SENSORS}, {FLAG_PARTS}"


@query("EVT-14", FLAGS + """ SELECT event_id, depth, round_even(first_vwc, 4) AS first_vwc, round_even(last_vwc, 4) AS last_pre_start_vwc, round_even(max_vwc, 4) AS max_pre_start_vwc, max_time AS max_pre_start_time,
  round_even(max_vwc - first_vwc, 4) AS pre_start_increase, round_even(missing, 4) AS vwc_missing_fraction_pre_start_window, round_even(total, 4) AS total_precip_in_pre_start_window,
  round_even(top, 4) AS max_precip_in_pre_start_window, t0 AS first_precip_time_pre_start_window, t1 AS last_precip_time_pre_start_window, round_even(a_min_v, 4) AS battery_pre_start_min_v,
  round_even(b_min_v, 4) AS battery_event_min_v, responded AS flag_pre_start_response, responded AND rained AS likely_precip_driven_pre_start_response, suspect AS possible_battery_or_logger_issue,
  responded AND NOT rained AND NOT suspect AS flag_unexplained_pre_start_response FROM z""")
def evt_14(spark, sf):
    return flags(spark, sf).select(
        "event_id", "depth", "first_vwc", "last_pre_start_vwc", "max_pre_start_vwc", "max_pre_start_time", "pre_start_increase",
        "vwc_missing_fraction_pre_start_window", "total_precip_in_pre_start_window", "max_precip_in_pre_start_window",
        "first_precip_time_pre_start_window", "last_precip_time_pre_start_window", "battery_pre_start_min_v", "battery_event_min_v",
        "flag_pre_start_response", "likely_precip_driven_pre_start_response", "possible_battery_or_logger_issue", "flag_unexplained_pre_start_response")


# the verdict on every analysed sensor: measured delays, volumes and durations missing from some events
TRUST = RESULTS + PROFILE + ", " + FLAG_PARTS + """, y AS (SELECT z.*, f.bottom_response_delay_hr AS delay, CASE WHEN event_id % 11 <> 0 THEN f.gallons_strip END AS gal,
  CASE WHEN event_id % 13 <> 0 THEN f.event_duration_hours END AS dur FROM z JOIN full_ f USING (event_id, depth)),
trust AS (SELECT event_id, depth, CASE WHEN r = '' THEN 'ok' ELSE r END AS trustworthy_reason, r = '' AS trustworthy_event FROM (
  SELECT event_id, depth, concat_ws('; ', CASE WHEN responded AND NOT rained AND NOT suspect THEN 'unexplained_pre_start_response' END, CASE WHEN suspect THEN 'possible_battery_or_logger_issue' END,
    CASE WHEN delay IS NULL THEN 'missing_bottom_response_delay' WHEN delay < 0.5 THEN 'bottom_response_too_early' END, CASE WHEN gal IS NULL THEN 'missing_gallons_strip' END,
    CASE WHEN dur IS NULL THEN 'missing_event_duration_hours' END) AS r FROM y)),
trusted AS (SELECT full_.* FROM full_ SEMI JOIN (SELECT * FROM trust WHERE trustworthy_event) t USING (event_id, depth))"""


def trust(spark, sf, rows):
    k = F.col("event_id")
    known = rows.withColumns({"gallons_strip": F.when(k % 11 != 0, F.col("gallons_strip")), "event_duration_hours": F.when(k % 13 != 0, F.col("event_duration_hours"))})
    return ev.event_trust(gappy(spark, sf), rain(spark, sf), known)


@query("EVT-15", TRUST + " SELECT event_id, depth, trustworthy_reason, trustworthy_event FROM trust")
def evt_15(spark, sf):
    return trust(spark, sf, derived_once(spark, sf)).select("event_id", "depth", "trustworthy_reason", "trustworthy_event")


MEAN_SD = ", ".join(f"round_even(avg({m}), 4) AS mean_{m}, round_even(stddev_samp({m}), 4) AS sd_{m}" for m in ev.CAPACITY_MEASURES)
IN_COLS = ", ".join(
    f"round_even(avg({m}_gal) / {GAL_IN!r}, 4) AS mean_{m}_in, round_even(avg({m}_gal), 4) AS mean_{m}_gal_scaled"
    for m in ("profile_baseline_storage", "profile_plateau_storage", "event_storage"))


@query("EVT-16", TRUST + f""" SELECT strip_group, location, strip, sensor_col, depth_inches, CAST(count(DISTINCT event_id) AS BIGINT) AS n_trustworthy_events, {MEAN_SD},
  {AREA}e0 AS profile_area_sqft, round_even({GAL_IN!r}e0, 4) AS gallons_per_profile_inch, {IN_COLS} FROM trusted GROUP BY strip_group, location, strip, sensor_col, depth_inches""")
def evt_16(spark, sf):
    rows = derived_once(spark, sf)
    return ev.holding_capacity(full(spark, sf, rows), trust(spark, sf, rows), AREA)


WB = ("gallons_strip", "event_storage_gal", "event_storage_in", "profile_area_sqft", "bottom_response_delay_hr", "time_to_peak_hours", "time_to_plateau_hours", "event_duration_hours")


@query("EVT-17", TRUST + " SELECT strip_group, location, strip, event_id, start, \"end\", CAST(count(DISTINCT sensor_col) AS BIGINT) AS n_trustworthy_depths, " +
       ", ".join(f"round_even(avg({m}), 4) AS mean_{m}" for m in WB) +
       """, round_even(avg(gallons_strip) - avg(event_storage_gal), 4) AS estimated_surplus_gal_strip,
  round_even(CASE WHEN avg(gallons_strip) > 0 THEN (avg(gallons_strip) - avg(event_storage_gal)) / avg(gallons_strip) END, 4) AS estimated_surplus_fraction
FROM trusted GROUP BY strip_group, location, strip, event_id, start, "end" """)
def evt_17(spark, sf):
    rows = derived_once(spark, sf)
    return ev.water_balance(full(spark, sf, rows), trust(spark, sf, rows))


@query("EVT-18", RESULTS + PROFILE + f""", s AS (SELECT event_id, depth, gallons_strip, baseline_vwc / 100 * depth_inches AS b, plateau_vwc / 100 * depth_inches AS p FROM full_)
SELECT event_id, depth, round_even(b, 4) AS profile_baseline_storage_in, round_even(p, 4) AS profile_plateau_storage_in, round_even((p - b) * {GAL_IN!r}, 4) AS event_storage_gal_scaled,
  round_even(gallons_strip - (p - b) * {GAL_IN!r}, 4) AS estimated_surplus_gal_strip, round_even(CASE WHEN gallons_strip > 0 THEN (gallons_strip - (p - b) * {GAL_IN!r}) / gallons_strip END, 4) AS estimated_surplus_fraction FROM s""")
def evt_18(spark, sf):
    return ev.scaled_storage(derived(spark, sf), AREA).select(
        "event_id", "depth", "profile_baseline_storage_in", "profile_plateau_storage_in", "event_storage_gal_scaled",
        "estimated_surplus_gal_strip", "estimated_surplus_fraction")


@query("EVT-19", """WITH c AS (SELECT 'orders' AS source_table, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS variable_name,
    unnest([0, 1, 2, 3, 4, 5]) AS position UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']), unnest([0, 1, 2])),
d AS (SELECT 'n_regionkey' AS variable_name, count(DISTINCT n_regionkey) || ' regions' AS definition FROM nation UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) || ' customers' FROM orders)
SELECT source_table, variable_name, position, definition FROM c LEFT JOIN d USING (variable_name)""")
def evt_19(spark, sf):
    orders, nation = table(spark, sf, "orders"), table(spark, sf, "nation")

    def definition(df, col, what):
        return df.agg(F.countDistinct(col).alias("n")).select(
            F.lit(col).alias("variable_name"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("definition"))

    definitions = definition(nation, "n_regionkey", "regions").unionByName(definition(orders, "o_custkey", "customers"))
    return ev.column_lineage({"orders": orders, "nation": nation}, definitions)
