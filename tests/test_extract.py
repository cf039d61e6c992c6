"""Event extracts: what belongs to an event is worked out once an event, not once a reading."""

import datetime as dt

from loamstream.catalog.all import QUERIES
from loamstream.operators import series

DAY0 = dt.datetime(2024, 5, 1)


def test_flow_is_rounded_before_the_join(spark, tmp_path):
    at = lambda h: DAY0 + dt.timedelta(hours=h)
    readings = spark.createDataFrame(
        [("S1", "1", at(h / 4), float(h)) for h in range(80)] + [("S1", "2", at(8), None), (None, "1", at(8), 1.0)],
        "strip string, depth string, ts timestamp_ntz, value double")
    rows = [(1, "S1", at(7), at(10), 100.0), (1, "S1", at(7), at(10), 100.0), (2, "S1", at(7), at(7), 50.0), (3, "S1", at(9), None, 7.0),
            (4, "S1", at(9), at(9 + 1 / 7), None), (5, None, at(9), at(10), 1.0), (None, "S1", at(9), at(16), 1 / 3)]
    events = spark.createDataFrame(rows, "event_id long, strip string, start timestamp_ntz, end timestamp_ntz, gallons_strip double")
    every = series.event_extract(readings, events, ["strip"], 1.0, 1.0)
    got = series.event_extract(readings, events, ["strip"], 1.0, 1.0, digits=6)
    names = sorted(every.columns)
    plain = [tuple(round(r[c], 6) if c in ("duration_h", "avg_flow_gph") and r[c] is not None else r[c] for c in names) for r in every.collect()]
    assert sorted(plain, key=repr) == sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert len(plain) == 6 * 9

    spark.createDataFrame([(1, at(0), 0, "purchase", 2.5, ""), (2, at(1), 12, "click", 3.0, "")],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["QRY-09"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Join")] and "round(" in plan
