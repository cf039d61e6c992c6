"""TIM-*: clocks, civil time and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeops as tm
from ..plans.slices import micros
from .base import ORDER_TIMES, READINGS, order_times, query, readings, table

SPLIT_TEXT = """texts AS (
  SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw,
    o_orderstatus AS source FROM orders)"""


def _texts(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("row_no"),
        F.when(k % 7 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 11 == 0, "n/a")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("raw"),
        F.col("o_orderstatus").alias("source"),
    )


@query("TIM-01", f"""WITH {SPLIT_TEXT}, p AS (
  SELECT *, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS ts FROM texts)
SELECT source, CAST(count(ts) AS BIGINT) AS good, CAST(count(*) - count(ts) AS BIGINT) AS rejected,
  min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY source""")
def tim_01(spark, sf):
    good, bad = tm.parse_ts(_texts(spark, sf), "raw")
    counts = good.select("source", "ts").unionByName(bad.select("source"), allowMissingColumns=True)
    return counts.groupBy("source").agg(
        F.count("ts").alias("good"), (F.count(F.lit(1)) - F.count("ts")).alias("rejected"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("TIM-02", f"""WITH {SPLIT_TEXT}
SELECT row_no, CAST(CASE WHEN source = 'F' THEN try_strptime(raw, '%m/%d/%Y')
  ELSE coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), NULL) END AS TIMESTAMP) AS ts
FROM (SELECT row_no, source, CASE WHEN source = 'F' THEN strftime(strptime_, '%m/%d/%Y') ELSE raw END AS raw
  FROM (SELECT o_orderkey AS row_no, o_orderstatus AS source, o_orderdate AS strptime_, raw
    FROM orders JOIN texts ON row_no = o_orderkey))""")
def tim_02(spark, sf):
    """Each status is a source with its own format; F files are written month first."""
    orders = table(spark, sf, "orders")
    mixed = _texts(spark, sf).join(
        orders.select(F.col("o_orderkey").alias("row_no"), "o_orderdate"), "row_no"
    ).withColumn("raw", F.when(F.col("source") == "F", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.col("raw")))
    return tm.parse_ts_formats(mixed, "raw", ["yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy"], ["source"]).select("row_no", "ts")


STEPS = {
    "S1T": [("2024-01-10 00:00:00", 60)],
    "S2M": [("2024-01-05 12:00:00", -60), ("2024-01-20 00:00:00", -120)],
    "S3B": [("2024-01-08 06:00:00", 90), ("2024-01-08 07:00:00", -30)],
}


@query("TIM-03", f"""WITH {READINGS}, s1 AS (
  SELECT *, CASE WHEN strip || location = 'S1T' AND ts >= TIMESTAMP '2024-01-10 00:00:00' THEN ts + to_minutes(60)
    WHEN strip || location = 'S2M' AND ts >= TIMESTAMP '2024-01-05 12:00:00' THEN ts - to_minutes(60)
    WHEN strip || location = 'S3B' AND ts >= TIMESTAMP '2024-01-08 06:00:00' THEN ts + to_minutes(90)
    ELSE ts END AS t1 FROM readings)
SELECT row_no, CASE WHEN strip || location = 'S2M' AND t1 >= TIMESTAMP '2024-01-20 00:00:00' THEN t1 - to_minutes(120)
    WHEN strip || location = 'S3B' AND t1 >= TIMESTAMP '2024-01-08 07:00:00' THEN t1 - to_minutes(30)
    ELSE t1 END AS ts FROM s1""")
def tim_03(spark, sf):
    return tm.correct_clock(readings(spark, sf), STEPS).select("row_no", "ts")


US_RULE = """years AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year FROM order_times),
edges AS (
  SELECT year, make_date(year, 4, 1) + CAST((7 - dayofweek(make_date(year, 4, 1))) % 7 AS INTEGER) AS spring,
    make_date(year, 10, 31) - CAST(dayofweek(make_date(year, 10, 31)) AS INTEGER) AS autumn
  FROM years)"""


@query("TIM-04", f"""WITH {ORDER_TIMES}, {US_RULE}
SELECT row_no, ts + to_hours(7) AS ts_utc,
  CASE WHEN ts + to_hours(7) >= spring + to_hours(9) AND ts + to_hours(7) < autumn + to_hours(8)
    THEN ts + to_hours(1) ELSE ts END AS ts_local
FROM order_times JOIN edges ON edges.year = year(ts)""")
def tim_04(spark, sf):
    civil = tm.to_civil(order_times(spark, sf))
    return civil.select("row_no", F.col("ts_utc").cast("timestamp_ntz").alias("ts_utc"), "ts_local")


def _transitions(spark, sf):
    return tm.dst_transitions(order_times(spark, sf).select(F.year("ts").alias("year")))


@query("TIM-05", f"""WITH {ORDER_TIMES}, {US_RULE}
SELECT row_no, CASE WHEN ts >= spring + to_hours(2) AND ts < spring + to_hours(3) THEN spring + to_hours(3) ELSE ts END AS ts
FROM order_times JOIN edges ON edges.year = year(ts)
WHERE NOT (ts >= autumn + to_hours(1) AND ts < autumn + to_hours(2))""")
def tim_05(spark, sf):
    return tm.normalize_local(order_times(spark, sf), _transitions(spark, sf)).select("row_no", "ts")


@query("TIM-06", f"""WITH {ORDER_TIMES}, {US_RULE}
SELECT year, spring + to_hours(9) AS at_utc, -420 AS before_min, -360 AS after_min, 'gap' AS kind,
  spring + to_hours(2) AS local_start, spring + to_hours(3) AS local_end FROM edges
UNION ALL SELECT year, autumn + to_hours(8), -360, -420, 'fold', autumn + to_hours(1), autumn + to_hours(2) FROM edges""")
def tim_06(spark, sf):
    return _transitions(spark, sf)


@query("TIM-07", f"""WITH {ORDER_TIMES}
SELECT row_no, ts FROM order_times WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'""")
def tim_07(spark, sf):
    return tm.year_window(order_times(spark, sf), 1997).select("row_no", "ts")


@query("TIM-08", f"""WITH {ORDER_TIMES}
SELECT row_no, 'plot' AS kind FROM order_times WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-04-01'
UNION ALL SELECT row_no, 'download' FROM order_times WHERE ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '1996-03-31'""")
def tim_08(spark, sf):
    rows = order_times(spark, sf)
    plot = tm.range_filter(rows, "1996-03-01", "1996-03-31")
    download = tm.range_filter(rows, "1996-03-01", "1996-03-31", last_day=False)
    return plot.select("row_no", F.lit("plot").alias("kind")).unionByName(
        download.select("row_no", F.lit("download").alias("kind"))
    )


@query("TIM-09", f"""WITH {READINGS}, seen AS (
  SELECT strip || location AS tag, max(ts) AS last_seen FROM readings GROUP BY 1)
SELECT tag, last_seen, TIMESTAMP '2024-01-31 00:00:00' AS pull_end,
  greatest(TIMESTAMP '2024-01-30 00:00:00', last_seen) AS pull_start FROM seen""")
def tim_09(spark, sf):
    seen = readings(spark, sf).groupBy(
        F.concat("strip", "location").alias("tag")
    ).agg(F.max("ts").alias("last_seen"))
    return tm.pull_window(seen, tm.ntz("2024-01-31 00:07:30"))


@query("TIM-10", f"""WITH {ORDER_TIMES}, {US_RULE}, tr AS (
  SELECT 'gap' AS kind, spring + to_hours(2) AS edge FROM edges UNION ALL
  SELECT 'fold', autumn + to_hours(1) FROM edges),
near AS (SELECT DISTINCT status, kind, edge, ts FROM order_times JOIN tr
  ON ts >= edge - to_hours(24) AND ts <= edge + to_hours(24)),
lagged AS (SELECT status, ts, kind, lag(ts) OVER (PARTITION BY status, kind, edge ORDER BY ts) AS prev_ts FROM near)
SELECT status, ts, kind, prev_ts, date_diff('microsecond', prev_ts, ts) / 60000000.0 AS step_min
FROM lagged WHERE date_diff('microsecond', prev_ts, ts) / 60000000.0 <> 15""")
def tim_10(spark, sf):
    return tm.dst_window_audit(order_times(spark, sf), _transitions(spark, sf), ["status"], hours=24)


@query("TIM-11", """SELECT event_id, TIMESTAMP '1990-01-01' + to_seconds(event_id * 900) AS ts FROM events""")
def tim_11(spark, sf):
    return table(spark, sf, "events").select("event_id", tm.epoch1990(F.col("event_id") * 900).alias("ts"))
