"""Meter sessions as a stream: many events a bucket, ends in any order, repeated messages, expired events."""

import datetime as dt

import pytest

from loamstream.streaming import ingest as ig
from loamstream.streaming import sessions as ss

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, kind string, ts timestamp_ntz, totalizer double, flow double, fraction double"


def at(hours):
    return DAY0 + dt.timedelta(hours=hours)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, folder, batches, **how):
    source, sink = f"{folder}/in", f"{folder}/out"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ss.stream_meter_sessions(spark.readStream.schema(SCHEMA).parquet(source), **how)
        ig.start_append(stream, sink, f"{folder}/mark").awaitTermination()
    out = spark.read.parquet(sink)
    return sorted(tuple(r) for r in out.select("event_id", "start_timestamp", "end_timestamp", "total_meter_gallons", "gallons_group", "avg_flow_gpm_group", "status").collect())


CLOCK = [(-1, "clock", at(9000), None, None, None)]


def test_sessions_are_matched_in_any_order_and_one_call_serves_many_events(rocks, tmp_path, monkeypatch):
    """One bucket for all events: the state is read and written by bucket, not by event."""
    first = [
        (1, "start", at(1), 5.0, 10.0, 0.5), (1, "finish", at(3), 7.0, 14.0, 1.0),  # whole in one batch
        (1, "finish", at(4), 9.0, 14.0, 1.0),  # once more, later: not used
        (2, "finish", at(3), 7.0, None, 1.0),  # its start comes later
        (3, "start", at(2), 1.0, 10.0, 1.0), (3, "start", at(2.5), 2.0, 10.0, 1.0),  # the later start counts
        (4, "start", at(2), 9.0, 4.0, 1.0), (5, "finish", at(2), 9.0, 4.0, 1.0),  # never completed
        (6, "start", at(2), 9.0, None, 1.0), (6, "finish", at(2), 8.0, None, 1.0),  # the meter runs back; no flow; one instant
    ]
    second = [(2, "start", at(0), 4.0, 6.0, 0.5), (3, "finish", at(6), 5.0, 20.0, 1.0), (1, "finish", at(3), 7.0, 14.0, 1.0)]
    got = run(rocks, str(tmp_path), [first, second, CLOCK], delay="60 days", buckets=1)
    assert got == [
        (1, at(1), at(3), 200.0, 100.0, 6.0, "complete"),
        (2, at(0), at(3), 300.0, 150.0, 3.0, "complete"),
        (3, at(2.5), at(6), 300.0, 300.0, 15.0, "complete"),
        (4, at(2), None, None, None, None, "unfinished"),
        (5, None, at(2), None, None, None, "unstarted"),
        (6, at(2), at(2), None, None, None, "rejected"),
    ]
