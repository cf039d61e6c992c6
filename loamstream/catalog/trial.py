"""MGT-*, SRC-08 and LAB-*: management and laboratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lab, management as mg
from ..plans import running_total
from ..plans.slices import shift
from .base import IRRIGATION, READINGS, irrigation, query, readings, table


def r6(c):
    return F.round(c, 6)


def raw_events(spark, sf):
    """Every event as a hand-written irrigation row: spellings vary, some fields are unusable."""
    k, ts = F.col("event_id"), F.col("ts")
    second = F.date_trunc("second", ts).cast("timestamp_ntz")
    end = shift(second, F.when(k % 17 == 0, -3600).otherwise((k % 9 + 1) * 1800))
    return table(spark, sf, "events").select(
        k.alias("k"), F.lit("2024").alias("year"), F.date_format(second, "yyyy-MM-dd HH:mm:ss").alias("start_timestamp"),
        F.when(k % 19 == 0, "later").otherwise(F.date_format(end, "yyyy-MM-dd HH:mm:ss")).alias("end_timestamp"),
        F.element_at(F.array(*[F.lit(x) for x in ("1 & 2", "S1_S2", "3and4", "s3-s4", "", "field nine")]), (k % 6 + 1).cast("int")).alias("strip_group"),
        F.element_at(F.array(*[F.lit(x) for x in ("West", "E", " west ", "", "East")]), (k % 5 + 1).cast("int")).alias("location"),
        F.when(k % 13 == 0, "n/a").otherwise((k * 10 + 7).cast("string")).alias("gallons"), F.when(k % 4 == 0, (k % 50).cast("string")).alias("avg_flow_gpm"),
        F.when(k % 23 == 0, F.concat(F.lit("id"), k.cast("string"))).alias("event_id"), F.lit(" note ").alias("notes"),
    )


BASE = """raw AS (SELECT event_id AS k, date_trunc('second', ts) AS s, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN date_trunc('second', ts) - to_hours(1) ELSE date_trunc('second', ts) + to_minutes((event_id % 9 + 1) * 30) END AS e,
    CASE event_id % 5 WHEN 0 THEN 'west' WHEN 1 THEN 'east' WHEN 2 THEN 'west' WHEN 4 THEN 'east' END AS location, event_id % 6 AS g, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 10 + 7 AS DOUBLE) END AS gal,
    CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS flow, CASE WHEN event_id % 23 = 0 THEN 'id' || event_id ELSE '' END AS event_id FROM events),
base AS (SELECT *, CASE WHEN g IN (0, 1) THEN 'S1_S2' WHEN g IN (2, 3) THEN 'S3_S4' WHEN g = 5 THEN 'FIELD NINE' WHEN location = 'west' THEN 'S1_S2' WHEN location = 'east' THEN 'S3_S4' END AS strip_group FROM raw),
chk AS (SELECT *, concat_ws('; ', CASE WHEN e IS NULL THEN 'invalid end_timestamp' END, CASE WHEN strip_group IS NULL THEN 'invalid strip_group' END, CASE WHEN location IS NULL THEN 'invalid location' END,
  CASE WHEN gal IS NULL THEN 'no usable volume' END, CASE WHEN e < s THEN 'end before start' END, CASE WHEN strip_group = 'FIELD NINE' THEN 'unsupported strip_group' END) AS reject_reason FROM base)"""

EXPANDED = BASE + """, x AS (SELECT *, unnest(CASE strip_group WHEN 'S1_S2' THEN ['S1', 'S2'] ELSE ['S3', 'S4'] END) AS strip, date_diff('second', s, e) / 3600.0::DOUBLE AS h FROM chk WHERE reject_reason = ''),
clean AS (SELECT k, s AS start_timestamp, e AS end_timestamp, strip_group, strip, location, round_even(gal, 0) AS gallons_group, round_even(gal * 0.5, 0) AS gallons_strip, round_even(flow * 0.5, 1) AS avg_flow_gpm_strip, round_even(h, 2) AS event_duration_hours,
  round_even(gal * 0.5 / CASE WHEN h > 0 THEN h END, 1) AS avg_flow_gph_strip, CASE WHEN event_id = '' THEN strftime(s, '%Y-%m-%d') || '_' || strip_group || '_' || substr(sha1(concat_ws('|', strftime(s, '%Y-%m-%d'), strftime(s, '%Y-%m-%d %H:%M:%S'), strftime(e, '%Y-%m-%d %H:%M:%S'), strip_group)), 1, 8) ELSE event_id END AS event_id FROM x)"""


@query("MGT-01", f"WITH {BASE} SELECT CAST(2024 AS INTEGER) AS year, strftime(s, '%Y-%m-%d') AS date, s AS start_timestamp, e AS end_timestamp, strip_group, location, gal AS gallons_group, 1.0::DOUBLE AS flow_allocation_fraction, flow AS avg_flow_gpm_group, event_id, 'note' AS notes FROM base")
def mgt_01(spark, sf):
    out = mg.normalize_events(raw_events(spark, sf)).withColumn("flow_allocation_fraction", F.coalesce("flow_allocation_fraction", F.lit(1.0)))
    return out.select("year", "date", "start_timestamp", "end_timestamp", "strip_group", "location", "gallons_group", "flow_allocation_fraction", "avg_flow_gpm_group", "event_id", "notes")


@query("MGT-02", f"WITH {BASE} SELECT CASE WHEN reject_reason = '' THEN 'usable' ELSE reject_reason END AS verdict, CAST(count(*) AS BIGINT) AS n FROM chk GROUP BY 1")
def mgt_02(spark, sf):
    good, bad = mg.validate_events(mg.normalize_events(raw_events(spark, sf)))
    both = good.select(F.lit("usable").alias("verdict")).unionByName(bad.select(F.col("reject_reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def clean_events(spark, sf, where=None):
    raw = raw_events(spark, sf)
    return mg.expand_to_strips(mg.validate_events(mg.normalize_events(raw.filter(where) if where else raw))[0])


SHOW = ("start_timestamp", "end_timestamp", "strip_group", "strip", "location", "gallons_group", "gallons_strip", "avg_flow_gpm_strip", "event_duration_hours", "avg_flow_gph_strip")


@query("MGT-03", f"WITH {EXPANDED} SELECT {', '.join(SHOW)} FROM clean")
def mgt_03(spark, sf):
    return clean_events(spark, sf).select(*SHOW)


@query("MGT-04", f"WITH {EXPANDED} SELECT start_timestamp, strip, event_id FROM clean")
def mgt_04(spark, sf):
    return mg.backfill_event_id(clean_events(spark, sf)).select("start_timestamp", "strip", "event_id")


@query("MGT-05", f"WITH {EXPANDED} SELECT start_timestamp, strip, gallons_strip FROM clean WHERE k % 2 = 0 UNION ALL SELECT start_timestamp, strip, gallons_strip FROM clean WHERE k % 2 <> 0")
def mgt_05(spark, sf):
    """A file that repeats what is there and brings the odd half."""
    current = clean_events(spark, sf, "k % 2 = 0")
    return mg.append_unique(current, clean_events(spark, sf)).select("start_timestamp", "strip", "gallons_strip")


@query("SRC-08", """WITH l AS (SELECT event_id AS k, date_trunc('second', ts) AS s, date_trunc('second', ts) + to_minutes(CASE WHEN event_id % 5 = 0 THEN -300 ELSE 90 END) AS e, CASE event_id % 3 WHEN 0 THEN 'West' WHEN 1 THEN 's3_s4' ELSE 'north' END AS g, CAST(event_id % 40 AS DOUBLE) AS gal FROM events),
o AS (SELECT k, s, CASE WHEN e < s THEN e + to_days(1) ELSE e END AS e, unnest(CASE g WHEN 'West' THEN ['S1', 'S2'] ELSE ['S3', 'S4'] END) AS strip, gal FROM l WHERE g <> 'north' AND gal > 0)
SELECT CAST(k AS VARCHAR) AS event_id, strip, s AS start_timestamp, e AS end_timestamp, date_diff('second', s, e) / 3600.0::DOUBLE AS duration_hours, gal / 2 AS gallons_strip, round(gal / 2 / (date_diff('second', s, e) / 3600.0::DOUBLE), 6) AS avg_flow_gph_strip, CAST(2024 AS INTEGER) AS year FROM o""")
def src_08(spark, sf):
    """Legacy group rows: overnight ends, two groups known, one not."""
    k = F.col("event_id")
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    legacy = table(spark, sf, "events").select(
        k.cast("string").alias("event_id"), second.alias("start_timestamp"), shift(second, F.when(k % 5 == 0, -18000).otherwise(5400)).alias("end_timestamp"),
        F.when(k % 3 == 0, "West").when(k % 3 == 1, "s3_s4").otherwise("north").alias("strip_group"), (k % 40).cast("double").alias("gallons"))
    out = mg.load_events(legacy)
    return out.select("event_id", "strip", "start_timestamp", "end_timestamp", "duration_hours", "gallons_strip", r6("avg_flow_gph_strip").alias("avg_flow_gph_strip"), "year")


@query("MGT-06", """WITH m AS (SELECT event_id, (CAST(floor(value) AS DOUBLE) - 20) * 100 AS diff, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END AS f, CASE WHEN event_id % 4 > 0 THEN value END AS a, CASE WHEN event_id % 5 > 0 THEN value + 2 END AS b FROM events)
SELECT event_id, CASE WHEN diff >= 0 THEN diff END AS total_meter_gallons, CASE WHEN diff >= 0 THEN diff * f END AS gallons_group, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END * f, 6) AS avg_flow_gpm_group, diff < 0 AS rejected FROM m""")
def mgt_06(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf, "events").select(
        "event_id", F.lit(20.0).alias("start_totalizer_gal_x100"), F.floor(v).cast("double").alias("end_totalizer_gal_x100"),
        F.when(k % 3 == 0, "0.5").when(k % 3 == 1, "all").otherwise("0.25").alias("flow_allocation_fraction"),
        F.when(k % 4 > 0, v).alias("start_flow_gpm"), F.when(k % 5 > 0, v + 2).alias("end_flow_gpm"))
    return mg.meter_volume(rows).select("event_id", "total_meter_gallons", "gallons_group", r6("avg_flow_gpm_group").alias("avg_flow_gpm_group"), "rejected")


@query("MGT-07", """WITH l AS (SELECT event_id AS k, CAST(ts AS DATE) AS d, date_trunc('minute', ts) AS s, event_id % 4 AS g, CASE WHEN event_id % 7 > 0 THEN CAST(event_id AS DOUBLE) END AS gal, CASE WHEN event_id % 14 = 0 THEN '' ELSE 'x' END AS n FROM events),
t AS (SELECT *, CAST(d AS TIMESTAMP) + to_minutes((hour(s) * 60 + minute(s) + 400) % 1440) AS e FROM l)
SELECT CAST(year(s) AS INTEGER) AS year, CAST(d AS VARCHAR) AS date, s AS start_timestamp, CASE WHEN e < s THEN e + to_days(1) ELSE e END AS end_timestamp, CASE WHEN g = 0 THEN 'S1_S2' ELSE 'S3_S4' END AS strip_group, CASE WHEN g = 0 THEN 'west' ELSE 'east' END AS location, gal AS gallons, n AS notes
FROM t WHERE g < 2 AND (gal IS NOT NULL OR n <> '')""")
def mgt_07(spark, sf):
    """A log sheet with date and clock times; runs of 400 minutes, some past midnight."""
    k, ts = F.col("event_id"), F.col("ts")
    off = (F.hour(ts) * 60 + F.minute(ts) + 400) % 1440
    clock = F.format_string("%02d:%02d", F.floor(off / 60).cast("int"), (off % 60).cast("int"))
    rows = table(spark, sf, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm").alias("time_on"), clock.alias("time_off"),
        F.when(k % 4 == 0, "1 & 2").when(k % 4 == 1, "S3 and S4").otherwise("none").alias("strip_id"),
        F.when(k % 7 > 0, k.cast("string")).otherwise("?").alias("gal_used_x_100"), F.when(k % 14 == 0, " ").otherwise("x").alias("notes"))
    return mg.events_from_log(rows)


def meter(spark, sf):
    """A totalizer per user: running sum of whole units."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("units"))
    total = running_total(rows, ["user_id"], ["ts", "event_id"], F.col("units"), "reading")
    return total.select("user_id", "ts", "event_id", F.col("reading").cast("double").alias("reading"), F.concat(F.lit("photo_"), F.col("event_id").cast("string")).alias("filename"),
                        F.when(F.col("event_id") % 9 == 0, "video").otherwise("photo").alias("file_type"), F.lit("exif").alias("timestamp_source"))


METER = "meter AS (SELECT user_id, ts, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS reading, 'photo_' || event_id AS filename FROM events)"


@query("MGT-08", f"""WITH {METER}, l AS (SELECT *, lag(ts) OVER w AS pts, lag(reading) OVER w AS pr, lag(filename) OVER w AS pn FROM meter WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, (reading - pr) * 100 AS gal FROM l WHERE reading > pr),
b AS (SELECT *, CASE WHEN coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 6e7 > 600, true) THEN 1 ELSE 0 END AS brk FROM r), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ev FROM b),
e AS (SELECT user_id, ev, arg_min(pts, ts) AS start_timestamp, max(ts) AS end_timestamp, arg_min(pr, ts) AS start_reading_x100, arg_max(reading, ts) AS end_reading_x100, sum(gal) AS computed_gallons, arg_min(pn, ts) AS start_photo, arg_max(filename, ts) AS end_photo FROM s GROUP BY user_id, ev HAVING sum(gal) >= 8000)
SELECT * EXCLUDE (ev), format('meter_event_{{:03d}}', row_number() OVER (PARTITION BY user_id ORDER BY ev)) AS event_id FROM e""")
def mgt_08(spark, sf):
    return mg.meter_events(meter(spark, sf), ["user_id"], 8000.0, 600.0, order=["event_id"], name="filename")


@query("MGT-09", f"""WITH RECURSIVE {METER}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, filename, event_id) AS n FROM meter),
step AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(t TIMESTAMP, r DOUBLE, f VARCHAR)[] AS waiting, NULL::STRUCT(t TIMESTAMP, r DOUBLE, f VARCHAR) AS taken FROM meter
  UNION ALL SELECT user_id, n, CASE WHEN taken IS NULL THEN list_append(live, {{'t': ts, 'r': reading, 'f': filename}}) ELSE list_filter(live, lambda x: x.f <> taken.f) END, taken
  FROM (SELECT *, list_filter(live, lambda x: x.t < ts AND (reading - x.r) * 100 >= 8000)[1] AS taken
    FROM (SELECT m.user_id, m.n, m.ts, m.reading, m.filename, list_filter(step.waiting, lambda x: x.t >= m.ts - to_hours(24)) AS live FROM step JOIN m ON m.user_id = step.user_id AND m.n = step.n + 1)))
SELECT s.user_id, s.taken.t AS start_timestamp, m.ts AS end_timestamp, round_even(date_diff('microsecond', s.taken.t, m.ts) / 3.6e9, 3) AS duration_hours, s.taken.r AS start_reading_x100, m.reading AS end_reading_x100,
  (m.reading - s.taken.r) * 100 AS computed_gallons, s.taken.f AS start_filename, m.filename AS end_filename FROM step s JOIN m ON m.user_id = s.user_id AND m.n = s.n WHERE s.taken IS NOT NULL""")
def mgt_09(spark, sf):
    return mg.greedy_pairs(meter(spark, sf), ["user_id"], 24.0, 8000.0, row_id="event_id")


def known(spark, sf):
    """Purchases as known irrigation events of their user's meter, six hours long."""
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("ts").alias("start"), shift("ts", 6 * 3600).alias("end"), (F.floor("value") * 100).cast("double").alias("gallons"))


KNOWN = "known AS (SELECT event_id, user_id, ts AS start, ts + to_hours(6) AS \"end\", CAST(floor(value) * 100 AS DOUBLE) AS gallons FROM events WHERE event_type = 'purchase')"

PAIRS = f"""WITH {METER}, {KNOWN}, c AS (SELECT k.event_id, k.gallons, s.reading AS sr, e.reading AS er, s.ts AS st, e.ts AS et, s.filename AS sn, e.filename AS en, (e.reading - s.reading) * 100 AS gal, abs(date_diff('microsecond', k.start, s.ts)) / 3.6e9 AS sd, abs(date_diff('microsecond', k."end", e.ts)) / 3.6e9 AS ed
  FROM known k JOIN meter s ON s.user_id = k.user_id AND s.ts BETWEEN k.start - to_hours(4) AND k.start + to_hours(4) JOIN meter e ON e.user_id = k.user_id AND e.ts BETWEEN k."end" - to_hours(4) AND k."end" + to_hours(4) WHERE e.ts > s.ts AND e.reading > s.reading),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(gal - gallons) + (sd + ed) * 1000, st, et) AS k FROM c),
res AS (SELECT k.event_id, k.user_id, k.start, k."end", k.gallons, 'S' || (k.user_id % 2 * 2 + 1) || '_S' || (k.user_id % 2 * 2 + 2) AS strip_group, 'S' || (k.user_id % 2 * 2 + 1) || '_S' || (k.user_id % 2 * 2 + 2) AS matched_strip_group, st AS start_timestamp, et AS end_timestamp,
  round_even(date_diff('microsecond', st, et) / 3.6e9, 3) AS duration_hours, sr AS start_reading_x100, er AS end_reading_x100, round_even((sd + ed) / 2, 2) AS time_diff_hours, CASE WHEN b.event_id IS NULL THEN 'No valid start/end photo pair found within search windows.' ELSE '' END AS notes, sn AS start_filename, en AS end_filename, gal AS computed_gallons, round_even(gal - k.gallons, 0) AS gallons_difference, round_even(gal / nullif(k.gallons, 0), 3) AS gallons_ratio,
  round_even(sd, 2) AS start_time_diff_hours, round_even(ed, 2) AS end_time_diff_hours, CASE WHEN b.event_id IS NULL THEN 'no_photo_pair_found' ELSE 'event_driven_suggested' END AS review_status FROM known k LEFT JOIN b ON b.event_id = k.event_id AND b.k = 1)"""


def pairs(spark, sf):
    first = (F.col("user_id") % 2 * 2 + 1).cast("int")
    events = known(spark, sf).withColumn("strip_group", F.format_string("S%d_S%d", first, first + 1))
    return mg.match_event_pairs(events, meter(spark, sf), ["user_id"], group="strip_group")


@query("MGT-10", PAIRS + " SELECT * FROM res")
def mgt_10(spark, sf):
    return pairs(spark, sf)


NEAR = """{name}_p AS (SELECT l.*, r.{t} AS rt, {cols_r} FROM {l} l ASOF LEFT JOIN {r} r ON {on}l.{lt} >= r.{t}), {name}_n AS (SELECT l.{id}, r.{t} AS rt, {cols_r} FROM {l} l ASOF LEFT JOIN {r} r ON {on}l.{lt} < r.{t})"""


@query("MGT-11", """WITH a AS (SELECT event_id, value * 100 AS computed_gallons, ts + to_microseconds(CAST((floor(value) % 12 + 1) * 1800000000 AS BIGINT)) AS mid FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS other, value * 90 AS reported_gallons, ts + to_hours(1) AS mid FROM events WHERE event_type = 'signup'),
p AS (SELECT a.*, b.other, b.reported_gallons, b.mid AS bm FROM a ASOF LEFT JOIN b ON a.mid >= b.mid), n AS (SELECT a.event_id, b.other, b.reported_gallons, b.mid AS bm FROM a ASOF LEFT JOIN b ON a.mid < b.mid),
m AS (SELECT p.event_id, p.computed_gallons, p.bm IS NOT NULL AND (n.bm IS NULL OR p.mid - p.bm <= n.bm - p.mid) AS back, p.mid, p.bm AS pb, n.bm AS nb, p.other AS po, n.other AS no_, p.reported_gallons AS pr, n.reported_gallons AS nr FROM p JOIN n USING (event_id)),
z AS (SELECT event_id, computed_gallons, CASE WHEN back THEN po ELSE no_ END AS other, CASE WHEN back THEN pr ELSE nr END AS reported_gallons, abs(date_diff('microsecond', mid, CASE WHEN back THEN pb ELSE nb END)) / 3.6e9 AS h FROM m)
SELECT event_id, other, round(reported_gallons, 6) AS reported_gallons, round_even(h, 2) AS time_diff_hours, round(computed_gallons - reported_gallons, 6) AS gallons_difference, round_even(computed_gallons / nullif(reported_gallons, 0), 3) AS gallons_ratio FROM z""")
def mgt_11(spark, sf):
    ev = table(spark, sf, "events")
    a = ev.filter("event_type = 'purchase'").select("event_id", F.col("ts").alias("start"), shift("ts", (F.floor("value") % 12 + 1) * 3600).alias("end"), (F.col("value") * 100).alias("computed_gallons"))
    b = ev.filter("event_type = 'signup'").select(F.col("event_id").alias("other"), F.col("ts").alias("start"), shift("ts", 7200).alias("end"), (F.col("value") * 90).alias("reported_gallons"))
    out = mg.match_midpoint(a, b, ["other"])
    return out.select("event_id", "other", r6("reported_gallons").alias("reported_gallons"), "time_diff_hours", r6("gallons_difference").alias("gallons_difference"), "gallons_ratio")


@query("MGT-12", f"""WITH {KNOWN}, r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), e AS (SELECT user_id, start AS t, 'start' AS role, event_id AS eid, gallons FROM known UNION ALL SELECT user_id, "end", 'end', event_id, gallons FROM known),
p AS (SELECT r.*, e.t, e.role, e.eid, e.gallons FROM r ASOF LEFT JOIN e ON r.user_id = e.user_id AND r.ts >= e.t), n AS (SELECT r.event_id, e.t, e.role, e.eid, e.gallons FROM r ASOF LEFT JOIN e ON r.user_id = e.user_id AND r.ts < e.t),
m AS (SELECT p.event_id, p.ts, p.t IS NOT NULL AND (n.t IS NULL OR p.ts - p.t <= n.t - p.ts) AS back, p.t AS pt, n.t AS nt, p.role AS pr, n.role AS nr, p.eid AS pe, n.eid AS ne, p.gallons AS pg, n.gallons AS ng FROM p JOIN n USING (event_id)),
z AS (SELECT event_id, CASE WHEN back THEN pt ELSE nt END AS t, CASE WHEN back THEN pr ELSE nr END AS role, CASE WHEN back THEN pe ELSE ne END AS eid, CASE WHEN back THEN pg ELSE ng END AS g, ts FROM m), w AS (SELECT *, abs(date_diff('microsecond', t, ts)) / 6e7 AS d FROM z), q AS (SELECT *, coalesce(d <= 90, false) AS ok FROM w)
SELECT event_id, CASE WHEN ok THEN eid END AS matched_event_id, CASE WHEN ok THEN role END AS matched_role, CASE WHEN ok THEN t END AS matched_event_time, CASE WHEN ok THEN round_even(d, 2) END AS matched_time_diff_minutes, CASE WHEN ok THEN g / 100 END AS expected_reading_delta_x100,
  ok AS has_photo_evidence, coalesce(CASE WHEN ok THEN round_even(d, 2) > 15 END, true) AS review_needed FROM q""")
def mgt_12(spark, sf):
    seen = table(spark, sf, "events").filter("event_type = 'view'").select("event_id", "user_id", "ts")
    ev = known(spark, sf).withColumnRenamed("event_id", "known_id")
    out = mg.match_edges(seen, ev, ["user_id"], event_id="known_id")
    return out.select("event_id", "matched_event_id", "matched_role", "matched_event_time", "matched_time_diff_minutes", "expected_reading_delta_x100", "has_photo_evidence", "review_needed")


@query("MGT-13", PAIRS + """, u AS (SELECT start_filename AS f FROM res UNION SELECT end_filename FROM res)
SELECT review_status, event_id, CAST(NULL AS VARCHAR) AS photo_filename, notes FROM res UNION ALL SELECT CASE WHEN event_id % 9 = 0 THEN 'video_unmatched' ELSE 'unmatched_photo' END, NULL, filename, CASE WHEN event_id % 9 = 0 THEN 'video; possible mid-event/test; timestamp source: exif' ELSE '' END FROM meter WHERE filename NOT IN (SELECT f FROM u WHERE f IS NOT NULL)""")
def mgt_13(spark, sf):
    return mg.append_unmatched(pairs(spark, sf), meter(spark, sf)).select("review_status", "event_id", "photo_filename", "notes")


def sheet(spark, sf):
    """Fertilizer sheets from parts: products spelled in several ways, subtotal rows, single group values."""
    k = F.col("p_partkey")
    names = ("Urea", "11-52-0", " lbs of Sulfate of  Potash", "TOTAL lbs", "Lime", "Manganese Sulfate (MnSO4)")
    return table(spark, sf, "part").select(
        k.alias("sheet_row"), (F.lit(2023) + (k % 3)).cast("int").alias("year"), F.element_at(F.array(*[F.lit(n) for n in names]), (k % 6 + 1).cast("int")).alias("product"),
        (k % 100 + 1).cast("string").alias("a"), F.when(k % 4 > 0, (k % 70 + 2).cast("string")).otherwise("-").alias("b"),
        F.when(k % 4 > 1, (k % 50 + 3).cast("string")).alias("c"), F.when(k % 4 > 2, (k % 30 + 4).cast("string")).alias("d"))


SHEET = """sh AS (SELECT p_partkey AS k, CAST(2023 + p_partkey % 3 AS INTEGER) AS year, CASE p_partkey % 6 WHEN 0 THEN 'Urea' WHEN 1 THEN '11-52-0' WHEN 2 THEN 'lbs of Sulfate of  Potash' WHEN 3 THEN 'TOTAL lbs' WHEN 4 THEN 'Lime' ELSE 'Manganese Sulfate (MnSO4)' END AS product,
  CAST(p_partkey % 100 + 1 AS DOUBLE) AS a, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 70 + 2.0 ELSE 0 END AS b, CASE WHEN p_partkey % 4 > 1 THEN p_partkey % 50 + 3.0 ELSE 0 END AS c, CASE WHEN p_partkey % 4 > 2 THEN p_partkey % 30 + 4.0 ELSE 0 END AS d FROM part),
cl AS (SELECT *, p_ % 4 = 0 AS lone FROM (SELECT *, k AS p_ FROM sh WHERE product <> 'TOTAL lbs')),
ap AS (SELECT k AS sheet_row, year, product, unnest(['S1', 'S2', 'S3', 'S4']) AS strip, unnest(['biochar_half_water', 'control_half_water', 'biochar_full_water', 'control_full_water']) AS treatment,
  unnest(CASE WHEN lone THEN [a / 4, a / 4, a / 4, a / 4] ELSE [a, b::DOUBLE, c::DOUBLE, d::DOUBLE] END) AS applied_total_lb FROM cl)"""


def applications(spark, sf):
    return mg.applications_from_sheet(sheet(spark, sf), {"S1": "a", "S2": "b", "S3": "c", "S4": "d"}, ["sheet_row", "year"])


@query("MGT-14", f"WITH {SHEET} SELECT * FROM ap WHERE applied_total_lb > 0")
def mgt_14(spark, sf):
    return applications(spark, sf)


ACRES = "(47.0::DOUBLE * 370.0::DOUBLE / 43560.0::DOUBLE)"


@query("MGT-15", f"""WITH {SHEET}, f AS (SELECT *, CASE product WHEN 'Urea' THEN 0.46 WHEN '11-52-0' THEN 0.11 ELSE 0 END::DOUBLE AS n, CASE product WHEN '11-52-0' THEN 0.52::DOUBLE * 0.4364::DOUBLE ELSE 0 END AS p, CASE WHEN product LIKE 'lbs%' THEN 0.5::DOUBLE * 0.8301::DOUBLE ELSE 0 END AS kk,
  CASE WHEN product LIKE 'Mang%' THEN 0.32 ELSE 0 END::DOUBLE AS mn, CASE WHEN product LIKE 'lbs%' THEN 0.18 WHEN product LIKE 'Mang%' THEN 0.185 ELSE 0 END::DOUBLE AS s FROM (SELECT * REPLACE (applied_total_lb / 1.7::DOUBLE AS applied_total_lb) FROM ap) WHERE applied_total_lb > 0)
SELECT sheet_row, strip, round_even(applied_total_lb, 3) AS applied_total_lb, round_even(applied_total_lb / {ACRES}, 3) AS applied_lb_per_acre, """ + ", ".join(
    f"round_even(applied_total_lb * {c}, 3) AS {n}_applied_total_lb, round_even(applied_total_lb * {c} / {ACRES}, 3) AS {n}_applied_lb_per_acre" for n, c in (("n", "n"), ("p", "p"), ("k", "kk"), ("mn", "mn"), ("s", "s"))) + " FROM f")
def mgt_15(spark, sf):
    rows = applications(spark, sf).withColumn("applied_total_lb", F.col("applied_total_lb") / 1.7)
    out = mg.nutrient_budget(rows, mg.analysis_table(spark), F.lit(47.0 * 370.0 / 43560.0))
    return out.drop("year", "product", "treatment")


# ------------------------------------------------------------------ laboratory

def lab_sheet(spark, sf):
    """Lab sheet rows from parts: sample ids, dates and numbers as laboratories write them."""
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    day = F.date_add(F.lit("2021-03-01").cast("date"), (F.col("p_size") * 30).cast("int"))
    ids = ("STRIP 1", "s2_hay", "N1 strip-3", "S4BIO", "field 9")
    return table(spark, sf, "part").select(
        k.alias("row_no"), F.element_at(F.array(*[F.lit(x) for x in ids]), (k % 5 + 1).cast("int")).alias("sample_id"),
        F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "M/d/yyyy")).when(k % 31 == 0, "soon").otherwise(F.date_format(day, "M/d/yy")).alias("date_recd"),
        F.when(k % 7 == 0, "Not Reported").when(k % 7 == 1, "< 0.01").when(k % 7 == 2, "<5").when(k % 7 == 3, "--").when(k % 7 == 4, F.format_string("1,%03d", (k % 1000).cast("int"))).when(k % 7 == 5, "n.d.").otherwise((k % 90).cast("string")).alias("h2o_no3_n"),
        (k % 14).cast("string").alias("ph"), F.lit("lab").alias("Lab_No"), F.col("p_type").alias("texture"))


LAB = """sheet AS (SELECT p_partkey AS row_no, p_partkey AS k, make_date(2021, 3, 1) + CAST(p_size * 30 AS INTEGER) AS day, CASE p_partkey % 5 WHEN 0 THEN 'strip_1' WHEN 1 THEN 'strip_2' WHEN 2 THEN 'strip_3' WHEN 3 THEN 'strip_4' END AS strip,
  CASE WHEN p_partkey % 7 IN (0, 1, 2) THEN 0.0 WHEN p_partkey % 7 = 4 THEN 1000.0 + p_partkey % 1000 WHEN p_partkey % 7 = 6 THEN p_partkey % 90 END::DOUBLE AS no3, CAST(p_partkey % 14 AS DOUBLE) AS ph, p_type AS texture, p_size FROM part),
lab AS (SELECT *, CASE WHEN k % 3 = 2 AND k % 31 = 0 THEN NULL ELSE day END AS date_rec FROM sheet)"""


@query("LAB-01", f"WITH {LAB} SELECT row_no, strip FROM lab")
def lab_01(spark, sf):
    return lab_sheet(spark, sf).select("row_no", lab.strip_from_id(F.col("sample_id")).alias("strip"))


@query("LAB-02", f"WITH {LAB} SELECT row_no, no3 AS h2o_no3_n, ph FROM lab")
def lab_02(spark, sf):
    return lab.clean_lab_values(lab_sheet(spark, sf), ["h2o_no3_n", "ph"]).select("row_no", "h2o_no3_n", "ph")


@query("LAB-03", f"WITH {LAB} SELECT row_no, date_rec AS date_recd FROM lab")
def lab_03(spark, sf):
    return lab.lab_dates(lab_sheet(spark, sf), ["date_recd"]).select("row_no", "date_recd")


def standard(spark, sf):
    return lab.standardize_lab(lab_sheet(spark, sf), ["sample_id"], {"date_recd": "date_rec"}, ["lab_no"], (0, 6), ["texture", "row_no"])


@query("LAB-04", f"WITH {LAB} SELECT row_no, strip, date_rec, no3 AS h2o_no3_n, ph, ph AS soil_ph, no3 AS nitrate_n_ppm, texture, 0 AS begin_depth_in, 6 AS end_depth_in FROM lab")
def lab_04(spark, sf):
    return standard(spark, sf).drop("sample_id")


@query("LAB-05", """WITH c AS (SELECT row_number() OVER (ORDER BY a) AS ord, a AS actual FROM (SELECT DISTINCT p_brand || ' ' || p_name AS a FROM part)), f AS (SELECT 'Brand 7 bolt' AS x, 'bolt7' AS field, 1 AS o),
q AS (SELECT DISTINCT p_name AS field FROM part), al AS (SELECT field, 1 AS alias_ord, 'brand7' || replace(field, ' ', '_') AS alias FROM q UNION ALL SELECT field, 2, split_part(field, ' ', 2) || ' of ' || 'Brand' FROM q UNION ALL SELECT field, 3, split_part(field, ' ', 2) || ' 12' FROM q),
n AS (SELECT *, regexp_replace(lower(actual), '[^a-z0-9]+', '', 'g') AS nn, regexp_extract_all(lower(actual), '[a-z0-9]+') AS cw FROM c), m AS (SELECT *, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS aa, list_filter(regexp_extract_all(lower(alias), '[a-z0-9]+'), lambda w: w NOT IN ('ng', 'g')) AS aw FROM al),
h AS (SELECT field, CASE WHEN aa = nn THEN 0 WHEN starts_with(nn, aa) OR starts_with(aa, nn) THEN 1 WHEN list_has_all(cw, aw) THEN 2 END AS kind, alias_ord, ord, actual FROM m CROSS JOIN n), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY kind, alias_ord, ord) AS k FROM h WHERE kind IS NOT NULL)
SELECT q.field, r.actual, CAST(r.kind AS INTEGER) AS match_kind FROM q LEFT JOIN r ON q.field = r.field AND r.k = 1""")
def lab_05(spark, sf):
    """Raw headers are brand and name; a field is a part name with three spellings."""
    part = table(spark, sf, "part")
    names = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("actual")).distinct()
    columns = names.withColumn("ord", F.col("actual"))
    f = part.select(F.col("p_name").alias("field")).distinct()
    noun = F.split_part("field", F.lit(" "), F.lit(2))
    spell = F.array(F.concat(F.lit("brand7"), F.replace("field", F.lit(" "), F.lit("_"))), F.concat(noun, F.lit(" of Brand")), F.concat(noun, F.lit(" 12")))
    aliases = f.select("field", F.posexplode(spell).alias("_i", "alias")).select("field", (F.col("_i") + 1).alias("alias_ord"), "alias")
    return lab.resolve_headers(columns, aliases)


@query("LAB-06", """WITH b AS (SELECT p_partkey AS row_no, make_date(2021, 1, 1) + CAST((p_partkey // 9) AS INTEGER) AS date_rec, CASE WHEN p_partkey % 9 < 4 + (p_partkey // 9) % 2 THEN '' ELSE 'S' || (p_partkey % 4 + 1) || 'HAY' END AS strip FROM part),
n AS (SELECT date_rec, count(*) AS n FROM b WHERE strip = '' GROUP BY date_rec), r AS (SELECT row_no, row_number() OVER (PARTITION BY date_rec ORDER BY row_no) AS k FROM b JOIN n USING (date_rec) WHERE strip = '' AND n = 4)
SELECT row_no, date_rec, CASE WHEN k IS NOT NULL THEN 'strip_' || k WHEN strip <> '' THEN 'strip_' || substr(strip, 2, 1) END AS strip FROM b LEFT JOIN r USING (row_no)""")
def lab_06(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("row_no"), F.date_add(F.lit("2021-01-01").cast("date"), F.floor(k / 9).cast("int")).alias("date_rec"),
        F.when(k % 9 < 4 + F.floor(k / 9) % 2, "").otherwise(F.concat(F.lit("S"), (k % 4 + 1).cast("string"), F.lit("HAY"))).alias("strip"))
    return lab.backfill_strips(rows)


@query("LAB-07", f"""WITH {LAB}, u AS (SELECT 0 AS src, row_no, strip, date_rec, no3, ph FROM lab WHERE k % 2 = 0 AND strip IS NOT NULL AND date_rec IS NOT NULL UNION ALL SELECT 1, row_no, strip, date_rec, no3, NULL FROM lab WHERE k % 2 = 1 AND strip IS NOT NULL AND date_rec IS NOT NULL)
SELECT strip, date_rec, row_no, h2o_no3_n, ph FROM (SELECT strip, date_rec, row_no, no3 AS h2o_no3_n, ph, row_number() OVER (PARTITION BY strip, date_rec ORDER BY src DESC, row_no DESC) AS k FROM u) WHERE k = 1""")
def lab_07(spark, sf):
    rows = standard(spark, sf).filter("strip IS NOT NULL AND date_rec IS NOT NULL").select("strip", "date_rec", "row_no", "h2o_no3_n", "ph")
    return lab.merge_supplement(rows.filter("row_no % 2 = 0"), rows.filter("row_no % 2 = 1").withColumn("ph", F.lit(None).cast("double")))


def patched(spark, sf):
    rows = standard(spark, sf).filter("strip IS NOT NULL AND date_rec IS NOT NULL").select("strip", "date_rec", "row_no", "h2o_no3_n", "ph")
    supp = rows.filter("h2o_no3_n IS NOT NULL")
    return rows, lab.patch_missing(rows, supp, ["h2o_no3_n", "ph"], ["strip", "date_rec"])


PATCH = f"""WITH {LAB}, b AS (SELECT strip, date_rec, row_no, no3, ph FROM lab WHERE strip IS NOT NULL AND date_rec IS NOT NULL), s AS (SELECT strip, date_rec, arg_max(no3, row_no) AS n2, arg_max(ph, row_no) AS p2 FROM b WHERE no3 IS NOT NULL GROUP BY ALL),
p AS (SELECT row_no, coalesce(no3, n2) AS h2o_no3_n, coalesce(ph, p2) AS ph, CASE WHEN no3 IS NULL AND n2 IS NOT NULL THEN 1 ELSE 0 END AS filled FROM b LEFT JOIN s USING (strip, date_rec))"""


@query("LAB-08", PATCH + " SELECT row_no, h2o_no3_n, ph, CAST(filled AS INTEGER) AS filled FROM p")
def lab_08(spark, sf):
    return patched(spark, sf)[1].select("row_no", "h2o_no3_n", "ph", "filled")


@query("LAB-08:counts", PATCH + """ SELECT 'h2o_no3_n' AS "column", CAST(sum(filled) AS BIGINT) AS filled FROM p UNION ALL SELECT 'ph', 0""")
def lab_08_counts(spark, sf):
    before, after = patched(spark, sf)
    return lab.fill_counts(before, after, ["h2o_no3_n", "ph"])


@query("LAB-09", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS ndf_pct_db, p_retailprice AS moisture_pct, p_retailprice AS moisture_pct_db, p_retailprice AS ash_pct FROM part")
def lab_09(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = table(spark, sf, "part").select("p_partkey", (size * 2).alias("ndf_pct"), size.alias("ndf_pct_db"), price.alias("moisture_pct"), price.alias("moisture_pct_db"), price.alias("ash_pct"))
    return lab.prefer_dry_basis(rows)


@query("LAB-10", f"WITH {LAB} SELECT row_no, strip, coalesce(CASE WHEN k % 2 = 0 THEN ph END, no3) AS soil_ph_1_1, no3 AS \"1_1_soil_ph\", no3 AS ec_1_1 FROM lab WHERE strip IS NOT NULL AND k % 11 <> 0")
def lab_10(spark, sf):
    k = F.col("row_no")
    rows = lab.clean_lab_values(lab_sheet(spark, sf), ["h2o_no3_n", "ph"]).select(
        "row_no", "sample_id", F.when(k % 11 == 0, " ").otherwise("2023-01-01").alias("date_rec"), F.when(k % 2 == 0, F.col("ph")).alias("soil_ph_1_1"),
        F.col("h2o_no3_n").alias("1_1_soil_ph"), F.col("h2o_no3_n").alias("1_1_s_salts_mmho_cm"))
    return lab.lab_row_filter(rows).select("row_no", "strip", "soil_ph_1_1", "1_1_soil_ph", "ec_1_1")


def cells_raw(spark, sf):
    """Cells with one number, the same text twice, several numbers, or a mix."""
    k = F.col("p_partkey")
    raw = F.when(F.col("p_size") % 4 == 0, "none seen").when(F.col("p_size") % 4 == 1, (k % 40).cast("string")).when(F.col("p_size") % 4 == 2, "1,234").otherwise(F.when(k % 9 == 0, "n.d.").otherwise((k % 20).cast("string")))
    return table(spark, sf, "part").select(
        F.concat(F.lit("strip_"), (k % 4 + 1).cast("string")).alias("strip"), F.date_add(F.lit("2022-06-01").cast("date"), (F.col("p_size") * 15).cast("int")).alias("sampled_on"),
        F.lower("p_type").alias("analyte"), F.when(k % 29 == 0, " ").otherwise(raw).alias("raw"))


CELLS = """raw AS (SELECT 'strip_' || (p_partkey % 4 + 1) AS strip, make_date(2022, 6, 1) + CAST(p_size * 15 AS INTEGER) AS sampled_on, lower(p_type) AS analyte, CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'none seen' WHEN p_size % 4 = 1 THEN CAST(p_partkey % 40 AS VARCHAR)
    WHEN p_size % 4 = 2 THEN '1,234' WHEN p_partkey % 9 = 0 THEN 'n.d.' ELSE CAST(p_partkey % 20 AS VARCHAR) END AS raw FROM part),
g AS (SELECT strip, sampled_on, analyte, count(DISTINCT raw) AS d, count(raw) AS n, count(TRY_CAST(replace(raw, ',', '') AS DOUBLE)) AS m, min(raw) AS t, avg(TRY_CAST(replace(raw, ',', '') AS DOUBLE)) AS a FROM raw GROUP BY ALL),
cell AS (SELECT strip, sampled_on, analyte, CASE WHEN d = 1 AND m = n THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) WHEN n > 0 AND m = n THEN a END AS value, CASE WHEN d = 1 AND m = 0 THEN t END AS text_value FROM g)"""


def cells(spark, sf):
    return lab.lab_cell(cells_raw(spark, sf), ["strip", "sampled_on", "analyte"])


@query("LAB-11", f"WITH {CELLS} SELECT strip, sampled_on, analyte, round(value, 6) AS value, text_value FROM cell")
def lab_11(spark, sf):
    return cells(spark, sf).withColumn("value", r6(F.col("value")))


LAB_MATRIX = f"""WITH {CELLS}, c AS (SELECT * FROM cell WHERE year(sampled_on) >= 2022), p AS (SELECT analyte, sampled_on, max(CASE strip WHEN 'strip_1' THEN value END) AS a, max(CASE strip WHEN 'strip_2' THEN value END) AS b, max(CASE strip WHEN 'strip_3' THEN value END) AS c3, max(CASE strip WHEN 'strip_4' THEN value END) AS d FROM c GROUP BY ALL),
u AS (SELECT analyte, strip AS row_key, sampled_on, value FROM c UNION ALL SELECT analyte, 's1_s2', sampled_on, a / nullif(b, 0) FROM p UNION ALL SELECT analyte, 's3_s4', sampled_on, c3 / nullif(d, 0) FROM p)"""


@query("LAB-12", LAB_MATRIX + " SELECT analyte, row_key, sampled_on, round(value, 6) AS value FROM u")
def lab_12(spark, sf):
    return lab.lab_matrix(cells(spark, sf), min_year=2022).withColumn("value", r6(F.col("value")))


@query("LAB-13", f"WITH {CELLS} SELECT analyte AS row_key, 'x' AS variable, sampled_on, round(avg(TRY_CAST(raw AS DOUBLE)), 6) AS value FROM raw GROUP BY analyte, sampled_on")
def lab_13(spark, sf):
    rows = cells_raw(spark, sf).withColumn("X", F.col("raw").try_cast("double"))
    return lab.lab_long_matrix(rows, "analyte", "sampled_on", {"x": ["unknown"]}).withColumn("value", r6(F.col("value")))


@query("LAB-13:wide", """WITH w AS (SELECT p_name || '' AS location, sum(CASE WHEN p_size % 3 = 0 THEN p_retailprice END) AS a, sum(CASE WHEN p_size % 3 = 1 THEN p_retailprice END) AS b, sum(p_retailprice) AS c FROM part GROUP BY 1)
SELECT location, DATE '2023-06-12' AS sampled_on, round(b, 4) AS value FROM w UNION ALL SELECT location, DATE '2024-01-05', round(c, 4) FROM w""")
def lab_13_wide(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    wide = table(spark, sf, "part").groupBy(F.concat(F.lit(" "), "p_name").alias("location")).agg(
        F.sum(F.when(size % 3 == 0, price)).alias("2022-07-01"), F.sum(F.when(size % 3 == 1, price)).alias("6/12/2023"), F.sum(price).alias("1/5/24"))
    return lab.lab_wide_matrix(wide, "location", 2023).withColumn("value", F.round("value", 4))


@query("LAB-14", """WITH b AS (SELECT c_mktsegment AS reference_key, unnest([1, 2, 3]) AS ord, unnest(['low', 'middle', 'top']) AS label, unnest([NULL, 0.0, 4000.0]) + CASE c_mktsegment WHEN 'BUILDING' THEN 100 ELSE 0 END AS lo, unnest([0.0, 4000.0, NULL]) + CASE c_mktsegment WHEN 'BUILDING' THEN 100 ELSE 0 END AS hi FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, c_acctbal AS value, label FROM customer LEFT JOIN b ON c_mktsegment = reference_key AND (lo IS NULL OR c_acctbal >= lo) AND (hi IS NULL OR c_acctbal < hi)""")
def lab_14(spark, sf):
    cust = table(spark, sf, "customer")
    move = F.when(F.col("c_mktsegment") == "BUILDING", 100.0).otherwise(0.0)
    null = F.lit(None).cast("double")

    def band(i, label, lo, hi):
        return F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), lo.alias("min_value"), hi.alias("max_value"), F.lit(True).alias("include_min"), F.lit(False).alias("include_max"))

    bands = cust.select("c_mktsegment").distinct().withColumn("_b", F.explode(F.array(
        band(1, "low", null, F.lit(0.0) + move), band(2, "middle", F.lit(0.0) + move, F.lit(4000.0) + move), band(3, "top", F.lit(4000.0) + move, null),
    ))).select(F.col("c_mktsegment").alias("reference_key"), "_b.*")
    rows = cust.select("c_custkey", F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("reference_key"))
    return lab.band_label(rows, bands).select("c_custkey", "value", "label")


@query("LAB-15", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS value FROM part")
def lab_15(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("a"), F.col("p_brand").alias("b"))
    return rows.select("p_partkey", lab.first_value(rows, ["missing", "a", "b"]).alias("value"))


@query("LAB-16", f"WITH {LAB} SELECT strip, date_rec, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY strip, date_rec")
def lab_16(spark, sf):
    return lab.lab_report(standard(spark, sf), ["strip", "date_rec", "soil_ph"])[0]


@query("LAB-16:columns", f"""WITH {LAB} SELECT 'missing' AS issue, 'boron_ppm' AS "column", 0::BIGINT AS n_values UNION ALL SELECT 'unmatched', 'h2o_no3_n', count(no3) FROM lab UNION ALL SELECT 'unmatched', 'ph', count(ph) FROM lab
UNION ALL SELECT 'unmatched', 'nitrate_n_ppm', count(no3) FROM lab UNION ALL SELECT 'unmatched', 'texture', count(texture) FROM lab""")
def lab_16_columns(spark, sf):
    rows = standard(spark, sf).drop("sample_id")
    return lab.lab_report(rows, ["strip", "date_rec", "soil_ph", "boron_ppm"], ignore=["row_no", "begin_depth_in", "end_depth_in"])[1]
