"""Events, diagnostics, matching, lab and streams on small fixed data and against brute force."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstream.operators import battery as bt, clocks as ck, events as ev, lab, management as mg, quality as dq, reconcile as rc, textaudit as tx
from loamstream.streaming import frames as fr

D = dt.datetime
T0 = D(2024, 6, 1)
M = dt.timedelta(minutes=1)


def plateau_twin(points, cfg=ev.EventConfig()):
    """Baseline, peak and plateau of one series, start at T0, in plain Python."""
    pts = sorted((t, v) for t, v in points if v is not None)
    low = [v for t, v in pts if T0 - 120 * M <= t <= T0]
    base = statistics.median(low) if low else None
    high = [(t, v) for t, v in pts if T0 <= t <= T0 + 24 * 60 * M]
    if not high:
        return base, None, None, "no_peak", None
    top = max(v for _, v in high)
    at = min(t for t, v in high if v == top)
    if base is not None and top - base < 0.5:
        return base, top, at, "no_peak", None
    sub = [(t, v) for t, v in pts if at <= t <= at + 16 * 60 * M]
    if len(sub) < 4:
        return base, top, at, "insufficient_data", None
    step = statistics.median([(b[0] - a[0]).total_seconds() / 3600 for a, b in zip(sub, sub[1:])])
    vals = [v for _, v in sub]
    smooth = [sum(vals[max(0, i - 2):i + 2]) / len(vals[max(0, i - 2):i + 2]) for i in range(len(vals))]
    flat = [False] + [abs(b - a) / step <= 0.12 for a, b in zip(smooth, smooth[1:])]
    i = 0
    while i < len(flat):
        j = i
        while j < len(flat) and flat[j]:
            j += 1
        if j - i >= 4:
            return base, top, at, "flat_segment", statistics.median(vals[i:i + 4])
        i = max(j, i + 1)
    late = [v for t, v in sub if t >= at + 240 * M]
    return (base, top, at, "fallback_window", statistics.median(late[:4])) if late else (base, top, at, "fallback_empty", None)


def test_event_analysis_equals_twin(spark):
    rnd = random.Random(4)
    shapes = {
        1: [(T0 + 15 * i * M, 20.0 if i < 1 else 30.0 - min(i, 12) * 0.5) for i in range(-8, 90)],
        2: [(T0 + 15 * i * M, 20.0 + rnd.uniform(-3, 3)) for i in range(-8, 90)],
        3: [(T0 + 15 * i * M, 20.0) for i in range(-8, 90)],
        4: [(T0 + 15 * i * M, 25.0 + i) for i in range(0, 3)],
        5: [(T0 - 15 * i * M, 25.0) for i in range(1, 5)],
        6: [(T0 + 15 * i * M, None if i % 3 == 0 else 20.0 + (i > 0) * 5 * rnd.random()) for i in range(-8, 90)],
        7: [(T0 + 15 * i * M, 20.0 + 3.0 * (i in (4, 9))) for i in range(-8, 90)],
        8: [(T0 - 15 * M, 20.0)] + [(T0 + 15 * i * M, 40.0 - 2.0 * i) for i in range(0, 8)],
    }
    readings, events = [], []
    for k, pts in shapes.items():
        readings += [(t, f"P{k}", "B", "1", "VWC", v) for t, v in pts]
        events.append((k, f"P{k}", "B", T0, T0 + 360 * M, 1000.0))
    r = spark.createDataFrame(readings, "ts timestamp_ntz, strip string, location string, depth string, variable string, value double")
    e = spark.createDataFrame(events, "event_id int, strip string, location string, start timestamp_ntz, end timestamp_ntz, gallons_strip double")
    got = {x.event_id: x for x in ev.analyze_events(r, e, ["1"]).collect()}
    for k, pts in shapes.items():
        base, top, at, method, level = plateau_twin(pts)
        x = got[k]
        assert (x.baseline_vwc, x.peak_vwc, x.peak_time, x.plateau_method) == (base, top, at, method), k
        assert x.plateau_vwc == (pytest.approx(level) if level is not None else None)
    joined = ev.window_join(e.select("event_id", "strip", "location", "start"), r, 2.0, 40.0)
    apart = {x.event_id: (x.plateau_method, x.plateau_vwc) for x in ev.plateau(joined, ev.baseline_and_peak(joined)).collect()}
    assert apart == {k: (got[k].plateau_method, got[k].plateau_vwc) for k in shapes}
    assert {got[k].plateau_method for k in shapes} >= {"flat_segment", "no_peak", "insufficient_data", "fallback_empty"}


def test_zero_length_event_has_no_flow(spark):
    r = spark.createDataFrame([], "ts timestamp_ntz, strip string, location string, depth string, variable string, value double")
    e = spark.createDataFrame([(1, "S1", "B", T0, T0, 10.0)], "event_id int, strip string, location string, start timestamp_ntz, end timestamp_ntz, gallons_strip double")
    x = ev.analyze_events(r, e, ["1"]).first()
    assert (x.avg_flow_gph_strip, x.plateau_method, x.peak_found) == (None, "no_peak", False)


def test_profile_sums_are_zero_when_nothing_was_read(spark):
    df = spark.createDataFrame([(1, "S1", None, T0, T0, 10.0, None, None), (1, "S1", None, T0, T0, 10.0, None, None)],
                               "event_id int, strip string, location string, start timestamp_ntz, end timestamp_ntz, gallons_strip double, baseline_vwc double, plateau_vwc double")
    rows = ev.profile_storage(df, 100.0).collect()
    assert len(rows) == 2 and rows[0].event_storage_in == 0.0 and rows[0].n_profile_depths_used == 0


def test_trust_reasons_in_order(spark):
    df = spark.createDataFrame([(1, True, True, 0.1, None, 2.0), (2, False, False, 0.5, 1.0, 2.0), (3, False, False, None, 1.0, None)],
                               "i int, flag_unexplained_pre_start_response boolean, possible_battery_or_logger_issue boolean, bottom_response_delay_hr double, gallons_strip double, event_duration_hours double")
    got = {r.i: (r.trustworthy_event, r.trustworthy_reason) for r in ev.classify_trust(df).collect()}
    assert got == {
        1: (False, "unexplained_pre_start_response; possible_battery_or_logger_issue; bottom_response_too_early; missing_gallons_strip"),
        2: (True, "ok"), 3: (False, "missing_bottom_response_delay; missing_event_duration_hours")}


def test_short_brown_out_counts_in_its_bin(spark):
    """One low reading among many of a quarter hour: the mean is fine, the minimum and the flag are not."""
    rows = [("S1", "T", None, "BattV_Min", T0 - 60 * M + dt.timedelta(seconds=30 * i), 9.0 if i == 11 else 12.5) for i in range(40)]
    rows += [("S1", "T", d, "VWC", T0 - m * M, v) for d, m, v in (("1", 90, 20.0), ("1", 60, 21.0), ("1", 15, None), ("2", 30, 5.0), ("2", 15, 5.1), ("3", 15, 7.0))]
    readings = spark.createDataFrame(rows, "strip string, location string, depth string, variable string, ts timestamp_ntz, value double")
    events = spark.createDataFrame([(7, "S1", "T", d, T0, T0 + 60 * M) for d in ("1", "2", "3")], "event_id int, strip string, location string, depth string, start timestamp_ntz, end timestamp_ntz")
    rain = spark.createDataFrame([(T0 - 100 * M, 0.3), (T0 - 400 * M, 9.0)], "ts timestamp_ntz, precip_in double")
    got = {r.depth: r for r in ev.pre_start_flags(readings, rain, events).collect()}
    assert sorted(got) == ["1", "2"]  # one reading is too few
    r = got["1"]
    assert (r.battery_pre_start_min_v, r.battery_pre_start_low_count, r.battery_event_min_v) == (9.0, 1, None)
    assert r.possible_battery_or_logger_issue and r.flag_pre_start_response and r.likely_precip_driven_pre_start_response and not r.flag_unexplained_pre_start_response
    assert (r.total_precip_in_pre_start_window, r.vwc_missing_fraction_pre_start_window, r.pre_start_increase) == (0.3, 0.3333, 1.0)
    alone = ev.battery_window(readings, events.select("event_id", "strip", "location", F.lit(T0 - 60 * M).cast("timestamp_ntz").alias("start"), F.lit(T0).cast("timestamp_ntz").alias("end")).distinct()).first()
    assert (alone.battery_min_v, alone.battery_low_count, alone.battery_out_of_range_fraction) == (9.0, 1, 0.025)


def test_single_event_target(spark):
    df = spark.createDataFrame([("S1", 30.0)], "strip string, plateau_vwc double")
    r = ev.statistical_target(df, ["strip"]).first()
    assert (r.sd_value, r.target_value, r.target_is_trustworthy) == (0.0, 30.0, False)


def greedy_twin(rows, hours, gallons):
    out = []
    for m in {r[0] for r in rows}:
        rs = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[4]))
        used = set()
        for i, a in enumerate(rs):
            if i in used:
                continue
            for j in range(i + 1, len(rs)):
                h = (rs[j][1] - a[1]).total_seconds() / 3600
                if h > hours:
                    break
                if j in used or h <= 0 or (rs[j][2] - a[2]) * 100 < gallons:
                    continue
                used |= {i, j}
                out.append((m, a[4], rs[j][4]))
                break
    return sorted(out)


def test_greedy_pairs_equal_the_sequential_rule(spark):
    rnd = random.Random(9)
    rows = []
    for m in (1, 2):
        t, total = T0, 0
        for _ in range(90):
            t += rnd.choice([0, 30, 90, 200, 700]) * M
            total += rnd.choice([0, 10, 60, 120])
            rows.append((m, t, float(total), len(rows), f"f{len(rows):04d}"))
    df = spark.createDataFrame(rows, "meter int, ts timestamp_ntz, reading double, row_id bigint, filename string")
    got = sorted((r.meter, r.start_filename, r.end_filename) for r in mg.greedy_pairs(df, ["meter"], 24.0, 10000.0, slice_days=1.0).collect())
    assert got == greedy_twin(rows, 24.0, 10000.0) and len(got) > 20
    assert mg.greedy_pairs(df.limit(0), ["meter"]).collect() == []


def test_greedy_chain_over_a_thousand_slices_takes_logarithmic_rounds(spark, monkeypatch):
    """Every slice hands its first rows on, and the first pair shifts all that follow."""
    rows = [("hot", T0 + 12 * 60 * i * M, 10.0 * i, i, f"f{i:05d}") for i in range(1, 2200)]
    rows += [("hot", T0 - 30 * M, 10.0, 0, "f00000"), ("b", T0, 1.0, 5000, "x"), ("b", T0 + 600 * M, 900.0, 5001, "y"), (None, T0, 1.0, 5002, "z"), ("b", None, 1.0, 5003, "w")]
    df = spark.createDataFrame(rows, "meter string, ts timestamp_ntz, reading double, row_id bigint, filename string")
    rounds, real = [], mg._greedy_runs
    monkeypatch.setattr(mg, "_greedy_runs", lambda *a: rounds.append(1) or real(*a))
    got = sorted((r.meter, r.start_filename, r.end_filename) for r in mg.greedy_pairs(df, ["meter"], 24.0, 1500.0, slice_days=1.0).collect())
    assert got == greedy_twin([r for r in rows if r[0] and r[1]], 24.0, 1500.0) and len(got) > 1000
    assert len(rounds) <= 1 + 2 * 11


def pair_twin(starts, ends, gallons):
    best = None
    for i, (t, r, d) in enumerate(starts):
        for j, (u, q, e) in enumerate(ends):
            if u > t and q > r:
                key = (abs((q - r) * 100.0 - gallons) + (d + e) * 1000.0, i, j)
                best = min(best or key, key)
    return best


def test_best_pair_equals_all_pairs():
    rnd = random.Random(21)
    for case in range(400):
        steps = [rnd.choice([-3, 0, 0, 1, 2, 5]) for _ in range(rnd.choice([3, 40, 160]))]
        at, line = 100, []
        for i, x in enumerate(steps):
            at += x if case % 3 else abs(x)
            line.append((i if case % 2 else i // 3, float(at)))
        cut = rnd.randint(0, len(line))
        sides = [[(t, r, abs(t - mid) * 0.013) for t, r in part] for part, mid in ((line[: cut + 30], 5), (line[max(0, cut - 30) :], 60))]
        gallons = rnd.choice([0.0, 150.0, 500.0, 4000.0, -200.0])
        want = pair_twin(*sides, gallons)
        arrays = [tuple(np.array(x) for x in zip(*side, strict=True)) if side else (np.zeros(0),) * 3 for side in sides]
        got = mg.best_pair(*arrays, gallons)
        assert (got is None) == (want is None)
        if want:
            (t, r, d), (u, q, e) = sides[0][got[0]], sides[1][got[1]]
            assert u > t and q > r and abs(abs((q - r) * 100.0 - gallons) + (d + e) * 1000.0 - want[0]) < 1e-6


def test_hot_window_is_searched_without_its_pairs(spark):
    """20,000 readings around one event: 10^8 pairs by brute force."""
    rows = [("m", T0 + dt.timedelta(seconds=i), 1000.0 + i // 2, f"f{i:05d}") for i in range(20_000)] + [("n", T0, 5.0, "a"), ("n", T0 + 60 * M, 9.0, "b"), ("n", T0 + 70 * M, None, "c")]
    events = [(1, "m", T0 + 60 * M, T0 + 200 * M, 400_000.0), (2, "n", T0, T0 + 60 * M, 399.0), (3, "n", T0 + 9000 * M, T0 + 9100 * M, 1.0), (4, "x", T0, T0, 1.0), (5, "m", None, T0, 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    try:
        got = {r.event_id: r for r in mg.match_event_pairs(
            spark.createDataFrame(events, "event_id int, meter string, start timestamp_ntz, end timestamp_ntz, gallons double"),
            spark.createDataFrame(rows, "meter string, ts timestamp_ntz, reading double, filename string"), ["meter"], place="meter").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    r = got[1]
    assert sorted(got) == [1, 2, 3, 4] and abs(r.computed_gallons - 400_000.0) <= 200 and r.start_time_diff_hours + r.end_time_diff_hours <= 0.12
    assert (got[2].start_filename, got[2].end_filename, got[2].duration_hours, got[2].matched_location) == ("a", "b", 1.0, "n")
    assert got[3].review_status == got[4].review_status == "no_photo_pair_found" and got[3].notes == mg.NO_PAIR


def block_twin(lines):
    best = (0, None, None)
    first = {}
    for i, l in enumerate(lines):
        first.setdefault(l, i)
    for a in sorted(range(len(lines)), key=lambda i: (first[lines[i]], i)):
        for b in range(a + 1, len(lines)):
            n = 0
            while b + n < len(lines) and lines[a + n] == lines[b + n]:
                n += 1
            if n > best[0]:
                best = (n, a, b)
    return best


def test_duplicate_block_equals_brute_force(spark):
    rnd = random.Random(11)
    files = {f: [rnd.choice("abcd") for _ in range(n)] for f, n in (("x", 40), ("y", 25), ("z", 3))}
    files["w"] = ["p", "q", "r"]
    files["v"] = ["same"] * 9
    rows = [(f, i, l) for f, ls in files.items() for i, l in enumerate(ls)]
    df = spark.createDataFrame(rows, "file string, pos int, line string")
    blocks = rc.duplicate_blocks(df, ["file"])
    got = {r.file: (r.block_len, r.first_start, r.second_start) for r in blocks.collect()}
    want = {f: block_twin(ls) for f, ls in files.items()}
    assert got == {f: w for f, w in want.items() if w[0] > 0}
    left = rc.drop_block(df, blocks, ["file"]).groupBy("file").count()
    assert {r.file: r["count"] for r in left.collect()}["v"] == 9 - want["v"][0]


def test_runs_gaps_and_continuity(spark):
    vals = [12, 9, 9, 12, None, 9, 17, 19, 12]
    df = spark.createDataFrame([("a", T0 + 15 * i * M, None if v is None else float(v)) for i, v in enumerate(vals)], "k string, ts timestamp_ntz, value double")
    got = sorted((r.start, r.n_points) for r in dq.threshold_runs(df, ["k"], F.col("value") < 9.6).collect())
    assert got == [(T0 + 15 * M, 2), (T0 + 75 * M, 1)]
    dup = df.unionByName(df.filter(F.col("ts") == T0)).filter(F.col("ts") != T0 + 45 * M)
    r = dq.continuity(dup, ["k"]).first()
    assert (r.n_points, r.n_duplicates, r.n_gaps, r.max_gap_min, r.expected_points, r.missing_points) == (9, 1, 1, 30.0, 9, 0)


def test_clock_step_priority(spark):
    steps = [75.0, -45.0, 0.0, -20.0, -200.0, 130.0, 15.0, 95.0, -35.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i int, s double")
    got = [r.k for r in df.orderBy("i").select(ck.classify_step(F.col("s")).alias("k")).collect()]
    assert got == ["setclock_forward", "setclock_backward", "duplicate_timestamp", "out_of_order", "nonmonotonic", "downtime_gap", None, "setclock_forward", "setclock_backward"]


def test_offset_runs_across_years(spark):
    rows = []
    for y in (2023, 2024):
        t = D(y, 5, 1)
        for i, step in enumerate([15, 75, 15, 15]):
            t += step * M
            rows.append(("L1", y, i, t))
    df = spark.createDataFrame(rows, "logger string, year int, row_no int, ts timestamp_ntz")
    got = [(r.year, r.cumulative_offset_min, r.implied_mode) for r in ck.clock_offset_timeline(df).orderBy("year").collect()]
    assert got == [(2023, 60, "MST"), (2024, 120, "MDT")]


def test_replacement_needs_stable_days(spark):
    vals = [11.0, 11.0, 12.5, 12.5, 12.4, 12.6, 12.5, 11.0, 12.4]
    df = spark.createDataFrame([("a", D(2024, 1, 1 + i, 5), v) for i, v in enumerate(vals)], "k string, ts timestamp_ntz, value double")
    days = bt.predawn(df, ["k"])
    steps = bt.replacement_steps(days, ["k"]).collect()
    assert [(r.time, r.stable_streak_days) for r in steps] == [(D(2024, 1, 3, 5), 5)]
    assert [(r.start_time, r.n_days) for r in bt.good_streaks(days, ["k"]).collect()] == [(D(2024, 1, 3, 5), 5)]


def test_each_candidate_is_used_once(spark):
    man = spark.createDataFrame([("a", 1, D(2024, 1, 5)), ("a", 2, D(2024, 1, 4)), ("a", 3, D(2024, 3, 1))], "k string, manual_no int, manual_date timestamp_ntz")
    cand = spark.createDataFrame([("a", D(2024, 1, 4), 1.0), ("a", D(2024, 3, 11), 2.0)], "k string, candidate_time timestamp_ntz, v double")
    got = {r.manual_no: (r.matched_candidate, r.cand_v) for r in bt.match_nearest(man, cand, ["k"], ["v"]).collect()}
    assert got == {1: (True, 1.0), 2: (False, None), 3: (True, 2.0)}


def test_validity_intervals(spark):
    iv = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 2, 1), "x"), ("a", D(2024, 1, 15), None, "y")], "k string, install_date timestamp_ntz, end_date timestamp_ntz, id string")
    assert [r.id for r in bt.validate_intervals(iv, ["k"]).collect()] == ["y"]
    r = spark.createDataFrame([("a", D(2023, 1, 1)), ("a", D(2024, 1, 10)), ("a", D(2030, 1, 1))], "k string, ts timestamp_ntz")
    assert [x.id for x in bt.active_at(r, iv, ["k"], ["id"]).orderBy("ts").collect()] == [None, "x", "y"]


def test_lab_cell_rule(spark):
    rows = [("one", "7"), ("twice", "None seen"), ("twice", "None seen"), ("nums", "1,000"), ("nums", "2000"), ("mixed", "3"), ("mixed", "high"), ("gone", " "), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, raw string")
    got = {r.k: (r.value, r.text_value) for r in lab.lab_cell(df, ["k"]).collect()}
    assert got == {"one": (7.0, None), "twice": (None, "None seen"), "nums": (1500.0, None), "mixed": (None, None), "gone": (None, None)}


def test_lab_numbers(spark):
    texts = ["<0.01", "Not Reported", "1,234", "--", "", "<7", "4.5", "oops", "NaN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(lab.lab_number(F.col("t")).alias("v")).collect()]
    assert got == [0.0, 0.0, 1234.0, None, None, 0.0, 4.5, None, None]


def test_strip_names(spark):
    texts = ["STRIP 1", "strip_2", "S3HAY", "N1 STRIP 4", "N1 S2", "field", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(lab.strip_from_id(F.col("t")).alias("v")).collect()]
    assert got == ["strip_1", "strip_2", "strip_3", "strip_4", "strip_2", None, None]


def test_events_to_strips_with_ids(spark):
    raw = spark.createDataFrame([("2024", "2024-06-01 08:00:00", "2024-06-01 10:00:00", "1 & 2", "West", "1001", None, None), ("2024", "2024-06-01 08:00:00", "2024-06-01 10:00:00", "", "e", None, "s3", "400"),
                                 ("2024", "bad", "2024-06-01 10:00:00", "S1_S2", "w", "5", None, None)],
                                "year string, start_timestamp string, end_timestamp string, strip_group string, location string, gallons string, strip string, gallons_strip string").withColumn("notes", F.lit(None).cast("string"))
    good, bad = mg.validate_events(mg.normalize_events(raw))
    assert bad.count() == 1
    got = sorted((r.strip, r.gallons_group, r.gallons_strip, r.avg_flow_gph_strip) for r in mg.expand_to_strips(good).collect())
    assert got == [("S1", 1001.0, 500.0, 250.2), ("S2", 1001.0, 500.0, 250.2), ("S3", 800.0, 400.0, 200.0)]
    with pytest.raises(Exception):
        mg.validate_events(mg.normalize_events(raw), strict=True)[0].collect()


def test_append_twice_changes_nothing(spark):
    df = spark.createDataFrame([("a", None, "g", "S1", 1.0)], "start_timestamp string, end_timestamp string, strip_group string, strip string, gallons_strip double")
    assert mg.append_unique(df, df).count() == 1


def test_meter_events_start_before_the_first_rise(spark):
    rows = [(0, 100), (60, 100), (120, 400), (240, 700), (500, 700), (560, 1000), (1200, 1001)]
    df = spark.createDataFrame([(T0 + m * M, float(r)) for m, r in rows], "ts timestamp_ntz, reading double")
    got = sorted((r.start_timestamp, r.end_timestamp, r.computed_gallons) for r in mg.meter_events(df).collect())
    assert got == [(T0 + 60 * M, T0 + 240 * M, 60000.0), (T0 + 500 * M, T0 + 560 * M, 30000.0)]


def test_term_search_context_and_cap(spark):
    df = spark.createDataFrame([(1, "Alpha\r\nbeta-gamma\nBETA GAMMA delta\n")], "doc_id int, text string")
    got = [(r.line_no, r.term, r.context_before, r.context_after) for r in tx.term_search(df, ["beta gamma", "alpha"]).orderBy("line_no").collect()]
    assert got == [(1, "alpha", "", "beta-gamma"), (2, "beta gamma", "Alpha", "BETA GAMMA delta"), (3, "beta gamma", "beta-gamma", "")]
    assert tx.term_search(df, ["beta gamma", "alpha"], max_matches=2).count() == 2


def test_anchor_suggestions(spark):
    pages = spark.createDataFrame([(1, '<a id="table-18-nitrate">x</a><p class="y" id=\'other\'>')], "page_id int, html string")
    links = spark.createDataFrame([(1, "table-18", "Table 18", None), (1, "other", None, None)], "page_id int, fragment string, table_number string, table_title string")
    broken, best = tx.anchor_audit(pages, links)
    assert [r.fragment for r in broken.collect()] == ["table-18"]
    assert [(r.rank, r.suggestion, r.score) for r in best.collect()] == [(1, "table-18-nitrate", 300 + 150 + 200 + 100 - 8)]


def test_terms_as_written_and_normalised(spark):
    """Signs only, odd letters, several terms in a line, blank lines, terms across joiners."""
    text = "\n\n  A--B/c  \nwa\u017f and \u212aelvin\n#tag 5%\nx\u00e9y the\n"
    df = spark.createDataFrame([("k1", text), ("k2", None), ("k3", ""), ("k4", "none\r\n\r\nhere the-end\rthe")], "doc string, body string")
    got = sorted((r.doc, r.line_no, r.term, r.line_text) for r in tx.term_search(df, ["a b", "WAS", "kelvin", "#", "5%", "the", "X Y"], key="doc", text="body", whole_word=False).collect())
    assert got == [
        ("k1", 3, "a b", "  A--B/c  "), ("k1", 4, "WAS", "wa\u017f and \u212aelvin"), ("k1", 4, "kelvin", "wa\u017f and \u212aelvin"), ("k1", 5, "#", "#tag 5%"), ("k1", 5, "5%", "#tag 5%"),
        ("k1", 6, "X Y", "x\u00e9y the"), ("k1", 6, "the", "x\u00e9y the"), ("k4", 3, "the", "here the-end"), ("k4", 4, "the", "the")]


@pytest.mark.parametrize("hot", [3, 1 << 16])
def test_names_meet_on_their_rarest_word(spark, hot):
    """One word is in a third of the names; its postings are dealt to parts."""
    from loamstream.plans.words import meet_on_rarest

    rnd = random.Random(31)
    words = ["steel"] * 6 + [f"w{i}" for i in range(12)]
    entries = [(i, sorted({rnd.choice(words) for _ in range(rnd.randint(1, 4))})) for i in range(150)]
    queries = [(f"q{i}", [rnd.choice(words) for _ in range(rnd.randint(1, 3))]) for i in range(40)] + [("gone", ["steel", "nowhere"]), ("empty", [])]
    out = meet_on_rarest(spark.createDataFrame(queries, "q string, qw array<string>"), spark.createDataFrame(entries, "e int, ew array<string>"), "qw", "ew", hot)
    assert sorted((r.q, r.e) for r in out.collect()) == sorted((q, e) for q, qw in queries for e, ew in entries if qw and set(qw) <= set(ew))


def test_many_ids_and_links_on_one_page(spark):
    """20,000 ids and links: rows are linear in both, no link carries the page's ids."""
    ids = [f"sec-{i:05d}" for i in range(20_000)]
    pages = spark.createDataFrame([(1, "".join(f'<a id="{i}">' for i in ids)), (2, '<p id="Top">')], "page_id int, html string")
    links = [(1, i if n % 2 else i[4:], None) for n, i in enumerate(ids)] + [(2, "top", None), (2, "", None), (3, "x", None), (2, None, "table 9")]
    broken, best = tx.anchor_audit(pages, spark.createDataFrame(links, "page_id int, fragment string, table_number string"))
    assert broken.count() == 10_000 + 4
    got = best.collect()
    assert {(r.fragment, r.suggestion) for r in got if r.page_id == 1} == {(i[4:], i) for n, i in enumerate(ids) if n % 2 == 0}
    assert [(r.fragment, r.suggestion, r.score) for r in sorted(got, key=lambda r: r.fragment) if r.page_id == 2] == [("", "Top", 447), ("top", "Top", 1450)]


def test_lab_column_report(spark):
    df = spark.createDataFrame([("1", None, 2.0, "x"), ("1", "d", None, None)], "strip string, date_rec string, `a.b` double, skip string")
    counts, columns = lab.lab_report(df, ["strip", "zinc"], ignore=["skip"])
    assert sorted(tuple(r) for r in columns.collect()) == [("missing", "zinc", 0), ("unmatched", "a.b", 1), ("unmatched", "date_rec", 1)] and counts.count() == 2
    assert lab.lab_report(df, df.columns)[1].collect() == []


def test_headers_by_exact_prefix_and_words(spark):
    cols = ["pH", "P.H. ", "Organic Matter LOI %", "Nitrate-N ppm", "CEC/Sum", "cec", "Zinc Zn ppm"]
    columns = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "ord int, actual string")
    al = [("ph", 1, "ph"), ("om", 1, "organic matter"), ("no3", 1, "ppm nitrate"), ("no3", 2, "zinc"), ("cec", 1, "ce"), ("long", 1, "cecxyz"), ("none", 1, "boron"), ("sign", 1, "%")]
    got = {r.field: (r.actual, r.match_kind) for r in lab.resolve_headers(columns, spark.createDataFrame(al, "field string, alias_ord int, alias string")).collect()}
    assert got == {"ph": ("pH", 0), "om": ("Organic Matter LOI %", 1), "no3": ("Zinc Zn ppm", 1), "cec": ("CEC/Sum", 1), "long": ("cec", 1), "none": (None, None), "sign": (None, None)}


def test_frames(spark):
    import struct

    vals = (12.5, 0.25, 1.0, 20.0, 0.25, 1.0, 20.0, 0.25, 1.0, 20.0)
    body = struct.pack(">10f", *vals)
    timed = b"\xff" * 20 + struct.pack(">I", 1_000_000_800) + body + b"\xff" * 30
    df = spark.createDataFrame([(1, (b"\x01\x02" + body).hex(" ")), (2, "zz"), (3, "00" * 60), (4, timed.hex())], "i int, PayloadHex string")
    got = {r.i: r.BattV_Min for r in fr.decode_frames(df, ["i"]).collect()}
    assert got == {1: 12.5, 4: 12.5}
    got = [(r.i, r.epoch_s, r.T_3_Avg) for r in fr.decode_frames(df, ["i"], timed=True).collect()]
    assert got == [(4, 1_000_000_800, 20.0)]


def test_repeated_rows_do_not_cancel_in_column_signatures(spark):
    from loamstream.operators import reconcile as rc

    old = spark.createDataFrame([("k", 5), ("k", 5), ("j", 1), ("n", None)], "k string, a int")
    new = spark.createDataFrame([("k", 9, 5, None), ("k", 9, 5, None), ("j", 1, 1, None), ("n", None, None, "")], "k string, x int, y int, z string")
    got = {r.old_column: (r.candidates, r.status) for r in rc.match_columns(old, new, "k", ["a"], ["x", "y", "z"]).collect()}
    assert got == {"a": ("y", "mapped")}
