"""Irrigation sessions from start and finish readings of a meter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = (
    "event_id bigint, start_us bigint, end_us bigint, total_meter_gallons double, gallons_group double, "
    "avg_flow_gpm_group double, status string"
)
# kind is 'start' or 'finish' while the other end is missing, 'done' after the session
OPEN = pa.schema([
    ("event_id", pa.int64()), ("kind", pa.string()), ("at_us", pa.int64()), ("totalizer", pa.float64()), ("flow", pa.float64()),
    ("fraction", pa.float64()), ("due_ms", pa.int64())])
BUCKETS = 512


class MeterSession(StatefulProcessor):
    """Holds one end of each event of a bucket until the other arrives, in either order, or its time runs out.

    The open events of a bucket are one Arrow batch in the state, so a bucket costs one read and one write per
    micro-batch, and events are matched as columns, not one by one.
    """

    def __init__(self, max_hours: float) -> None:
        self.max_ms = int(max_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")

    def _held(self) -> pd.DataFrame:
        if not self.open.exists():
            return _empty()
        with pa.ipc.open_stream(bytes(self.open.get()[0])) as r:
            return _typed(r.read_pandas())

    def _hold(self, rows: pd.DataFrame) -> None:
        if rows.empty:
            self.open.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, OPEN) as w:
            w.write_table(pa.Table.from_pandas(rows[OPEN.names], OPEN, preserve_index=False))
        self.open.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(rows["due_ms"].min()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["kind"].isin(["start", "finish"])]
        if new.empty:
            yield _frame(_empty())
            return
        held = self._held()
        new = new.sort_values(["at_us", "kind"], ascending=[True, False]).assign(due_ms=lambda r: r["at_us"] // 1000 + self.max_ms)
        both = pd.concat([held.assign(_new=0), _typed(new[OPEN.names]).assign(_new=1)], ignore_index=True)
        event = both.groupby("event_id", dropna=False, sort=False).ngroup()
        # what is held comes first, then messages by time
        both = both.assign(_event=event).sort_values(["_event", "_new"], kind="stable", ignore_index=True)
        of = both.groupby("_event", sort=False)
        # the first message of the other kind ends the session; with the row before it, it is the pair
        turn = both["kind"].ne(of["kind"].transform("first"))
        place = of.cumcount()
        at = place.where(turn).groupby(both["_event"]).transform("min")
        done = of["kind"].transform("first").eq("done")
        used = (place <= at.fillna(len(both))) & ~(done & (place > 0))  # the rest are the same messages once more
        due = both["due_ms"].where(used).groupby(both["_event"]).transform("min")
        both["due_ms"] = due.astype("int64")
        paired = at.notna() & ~done
        first, second = both[paired & (place == at - 1)].reset_index(drop=True), both[paired & (place == at)].reset_index(drop=True)
        is_start = first["kind"].eq("start")
        begun, ended = pd.concat([first[is_start], second[~is_start]]).sort_index(), pd.concat([second[is_start], first[~is_start]]).sort_index()
        last = both[used & ~paired].groupby("_event", sort=False).tail(1)
        self._hold(pd.concat([last, second.assign(kind="done")], ignore_index=True))
        yield _frame(_sessions(begun, ended))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = (held["due_ms"] <= expiredTimerInfo.getExpiryTimeInMs()) | (held["due_ms"] < timerValues.getCurrentWatermarkInMs())
        gone = held[over]
        self._hold(held[~over])
        started, kind = gone["kind"].eq("start"), gone["kind"]
        out = gone.assign(start_us=gone["at_us"].where(started), end_us=gone["at_us"].where(~started), status=kind.map({"start": "unfinished", "finish": "unstarted"}))
        yield _frame(out[kind.ne("done")])

    def close(self) -> None:
        pass


def _sessions(begun: pd.DataFrame, ended: pd.DataFrame) -> pd.DataFrame:
    """Sessions of pairs of rows."""
    gallons = (ended["totalizer"] - begun["totalizer"]).astype("float64") * 100.0
    falling = gallons < 0
    mean = pd.concat([begun["flow"], ended["flow"]], axis=1).astype("float64").mean(axis=1)
    fraction = begun["fraction"].astype("float64")
    told = gallons.mask(falling)
    return pd.DataFrame({
        "event_id": begun["event_id"], "start_us": begun["at_us"], "end_us": ended["at_us"], "total_meter_gallons": told, "gallons_group": told * fraction,
        "avg_flow_gpm_group": mean * fraction, "status": falling.map({True: "rejected", False: "complete"})})


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({"event_id": "Int64", "at_us": "int64", "due_ms": "int64", "totalizer": "float64", "flow": "float64", "fraction": "float64"})


def _empty() -> pd.DataFrame:
    return _typed(OPEN.empty_table().to_pandas())


def _frame(rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    out = rows.reindex(columns=names).reset_index(drop=True)
    for c in ("event_id", "start_us", "end_us"):
        out[c] = out[c].astype("Int64")
    for c in ("total_meter_gallons", "gallons_group", "avg_flow_gpm_group"):
        out[c] = out[c].astype("float64")
    out["status"] = out["status"].astype(object)
    return out


def stream_meter_sessions(stream: DataFrame, max_hours: float = 72.0, delay: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """Start and finish messages to sessions with volume, share and average flow.

    Messages have `event_id, kind ('start', 'finish' or 'clock'), ts, totalizer, flow, fraction`. The two ends of an event
    may come in any order and in different batches. State is one small row per open event, kept by buckets of events
    (`buckets` stays as it is for a checkpoint), so `delay`, how late a message may come, can be as long as a meter may be
    offline; Spark drops what comes later still. An event with one end is reported as `unfinished` or `unstarted` when
    event time passes `max_hours`; a `clock` message moves event time at the end of an input. Needs the RocksDB state store.
    """
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    # messages without an id are a bucket of their own, so that the ids of the others stay whole numbers in pandas
    bucket = F.when(F.col("event_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int")).alias("bucket")
    rows = timed.select(bucket, "event_id", "kind", F.unix_micros("event_time").alias("at_us"), "totalizer", "flow", "fraction", "event_time")
    out = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=MeterSession(max_hours), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.select(
        "event_id", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_timestamp"), F.timestamp_micros("end_us").cast("timestamp_ntz").alias("end_timestamp"),
        "total_meter_gallons", "gallons_group", "avg_flow_gpm_group", "status")
