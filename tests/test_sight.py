"""Events that see the same grid rows are analysed once; wide frames hold no row against every name."""

import datetime as dt

from loamstream import schema
from loamstream.operators import events as ev

DAY0 = dt.datetime(2024, 5, 1)


def at(minutes):
    return DAY0 + dt.timedelta(minutes=minutes)


def _trial(spark):
    """A week of readings at two depths, and events: many in one bin, on its edge, repeated, with one id or none."""
    level = lambda m, d: 20 + (m * 7 % 13) / 3 + (6 if 600 < m < 1500 else 0) + d
    grid = spark.createDataFrame(
        [("S1", p, str(d), at(m), float(level(m, d) + len(p))) for p in ("T", "MM") for d in (1, 2) for m in range(0, 4000, 15)],
        "strip string, location string, depth string, ts timestamp_ntz, value double")
    rows = [(i, "S1", "T", at(550 + i / 10)) for i in range(1, 41)]  # 551 to 554: one bin
    rows += [(50, "S1", "T", at(555)), (51, "S1", "T", at(540)), (52, "S1", "T", at(540.5)), (53, "S1", "MM", at(551))]
    rows += [(60, "S1", "T", at(551))] * 2 + [(61, "S1", "T", at(551)), (61, "S1", "MM", at(700))] + [(None, "S1", "T", at(551)), (None, "S1", "MM", at(551))]
    rows += [(70, None, "T", at(551)), (71, "S1", "T", None), (72, "S9", "T", at(551))]
    return grid, spark.createDataFrame(rows, "event_id bigint, strip string, location string, start timestamp_ntz")


def test_events_of_one_sight_are_analysed_once(spark, monkeypatch):
    grid, events = _trial(spark)
    cfg = ev.EventConfig()
    all_rows = ev.window_join(events, grid, cfg.baseline_hours, cfg.peak_hours + cfg.plateau_hours)
    rows = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    windows, real = [], ev.window_join
    monkeypatch.setattr(ev, "window_join", lambda spans, *a, **k: windows.append(spans.count()) or real(spans, *a, **k))
    for measure in (ev.event_measures, ev.baseline, ev.peak):
        assert rows(ev.by_sight(events, grid, measure)) == rows(measure(all_rows))
    # of 40 events in one bin one is joined; those on an edge, elsewhere, repeated or of mixed rows stay themselves
    assert all(n <= 15 for n in windows) and events.count() == 53


def test_wide_frame_looks_names_up(spark):
    names = [f"VWC_{d}_raw_S1_T" for d in "123"] + ["BattV_Min_S1_T"]
    rows = [(at(0), "S1", "T", "1", "VWC", 3.0), (at(0), "S1", "T", "1", "VWC", 4.0), (at(0), "S1", "T", "2", "VWC", None), (at(0), "S1", "T", "9", "BattV_Min", 12.0),
            (at(1), "S2", "T", "1", "VWC", 5.0), (at(2), None, None, None, None, 6.0), (None, "S1", "T", "3", "VWC", 7.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, strip string, location string, depth string, variable string, value double")
    wide = schema.to_wide(df, names)
    got = {r.ts: tuple(r)[1:] for r in wide.collect()}
    nothing = (None,) * 4
    assert wide.columns == ["ts", *names]
    assert got == {at(0): (4.0, None, None, 12.0), at(1): nothing, at(2): nothing, None: (None, None, 7.0, None)}
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(") == 1
    back = {(r.ts, r.depth, r.variable, r.value) for r in schema.to_long(wide).collect()}
    assert back == {(at(0), "1", "VWC", 4.0), (at(0), None, "BattV_Min", 12.0), (None, "3", "VWC", 7.0)}
