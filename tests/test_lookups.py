"""Events look their peaks up and share plateaus: equal to all rows of every window, on far fewer rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loamstream import plans
from loamstream.operators import events as ev

DAY0 = dt.datetime(2024, 5, 1)


def at(minutes):
    return DAY0 + dt.timedelta(minutes=minutes)


def test_range_max_equals_naive(spark):
    rnd = random.Random(7)
    points = [(rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), at(rnd.choice([15 * rnd.randrange(400), rnd.uniform(0, 6000)])), rnd.choice([None, float(rnd.randrange(50))])) for _ in range(300)]
    starts = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, at(15 * rnd.randrange(-100, 400)), at(rnd.uniform(-1500, 6000))])) for i in range(150)]
    p = spark.createDataFrame(points, "k string, d string, ts timestamp_ntz, v double")
    s = spark.createDataFrame(starts, "i int, k string, s timestamp_ntz")
    for seconds in (900, 7200.0, 86400):
        got = {(r.i, r.d): r.top for r in plans.range_max(p, s, ["k"], ["d"], "ts", F.col("v"), "s", seconds, "top").collect()}
        want = {}
        for i, k, t in starts:
            for k2, d, ts, v in points:
                if t and v is not None and k is not None and k == k2 and t <= ts <= t + dt.timedelta(seconds=seconds):
                    want[i, d] = max(v, want.get((i, d), v))
        assert got == want and want


def test_events_are_looked_up(spark, monkeypatch):
    """Forty events see one peak from forty bins: its rows are settled once. Odd ids and missing depths stay as they were."""
    rise = lambda m, d: 20 + d + (9 if m == 1500 else (m * 7 % 13) / 90 + (2 if 1500 < m < 2400 else 0))
    grid = [("S1", p, d, at(m), None if m % 390 == 0 else float(rise(m, len(d or "")))) for p in ("T", "MM") for d in ("1", "22", None) for m in range(0, 4000, 15)]
    grid += [("S1", "B", "1", at(m), None) for m in range(0, 900, 15)] + [("S1", "B", "22", at(2400), 5.0)]
    grid = spark.createDataFrame(grid, "strip string, location string, depth string, ts timestamp_ntz, value double")
    rows = [(i, "S1", "T", at(800 + 15 * i + i % 3)) for i in range(40)]
    odd = [(50, "S1", "T", at(900)), (50, "S1", "T", at(900)), (51, "S1", "T", at(903)), (51, "S1", "MM", at(1203)), (52, "S1", "B", at(60)), (53, "S1", "B", at(15)),
           (54, "S1", "T", None), (55, None, "T", at(900)), (56, "S9", "T", at(900)), (57, "S1", "T", at(5000)), (58, "S1", "T", at(3999)), (None, "S1", "MM", at(301))]
    schema = "event_id bigint, strip string, location string, start timestamp_ntz"
    events = spark.createDataFrame(rows + odd, schema)
    cfg = ev.EventConfig()
    every = ev.window_join(events, grid, cfg.baseline_hours, cfg.peak_hours + cfg.plateau_hours)
    plain = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    for measure in (ev.event_measures, ev.baseline, ev.peak):
        assert plain(ev.measured_events(events, grid, measure)) == plain(measure(every))

    settled, real = [], ev._settle
    monkeypatch.setattr(ev, "_settle", lambda rows, *a: settled.append(rows.count()) or real(rows, *a))
    readings = grid.filter("depth IS NOT NULL").withColumn("variable", F.lit("VWC"))
    timed = spark.createDataFrame(rows, schema).withColumns({"end": F.col("start"), "gallons_strip": F.lit(1.0)})
    got = ev.analyze_events(readings, timed, ["1", "22", "3"])
    assert sum(settled) <= 2 * 65  # 40 events, 2 depths, one peak each: 16 h of a sensor each, not 42 h of an event
    want = ev.event_measures(every.filter("event_id < 40 AND value IS NOT NULL"))
    cols = ["event_id", "depth", "baseline_vwc", "baseline_time", "peak_vwc", "peak_time", "plateau_vwc", "plateau_time", "plateau_method"]
    assert plain(got.filter("depth <> '3'").select(cols)) == plain(want.filter("depth IS NOT NULL").select(cols))
    assert got.count() == 120 and got.filter("depth = '3' AND plateau_method = 'no_peak'").count() == 40


def test_storage_of_repeated_and_missing_ids(spark):
    """An id's rows share what any of its places stored; no id, no storage."""
    readings = spark.createDataFrame([("S1", "T", "1", "VWC", at(0), 10.0), ("S1", "T", "2", "VWC", at(1), 20.0), ("S1", "M", "1", "VWC", at(0), 50.0), ("S1", "T", "1", "VWC", at(60), 40.0)],
                                     "strip string, location string, depth string, variable string, ts timestamp_ntz, value double")
    results = spark.createDataFrame([(1, "1", "S1", "T", at(0), at(60), 9.0), (2, "1", "S1", "T", at(0), None, 9.0), (2, "1", "S1", "M", at(0), None, 9.0), (None, "1", "S1", "T", at(0), at(60), 9.0), (3, "1", "S1", "T", at(30), None, 0.0)],
                                    "event_id int, depth string, strip string, location string, baseline_time timestamp_ntz, plateau_time timestamp_ntz, gallons_strip double")
    gal = lambda v: v / 100 * ev.CYLINDER_GAL
    got = sorted(((r.event_id, r.location, r.profile_baseline_storage_gal, r.profile_plateau_storage_gal) for r in ev.storage_at(results, readings).collect()), key=repr)
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    want = sorted([(1, "T", gal(30), gal(40)), (2, "T", gal(50), None), (2, "M", gal(50), None), (None, "T", None, None), (3, "T", None, None)], key=repr)
    assert len(got) == 5 and all(a[:2] == b[:2] and near(a[2], b[2]) and near(a[3], b[3]) for a, b in zip(got, want))
