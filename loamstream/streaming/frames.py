"""Decoding logger frames: big-endian floats somewhere inside a hex payload."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: record fields and their plausible ranges
FIELDS = ("BattV_Min", "VWC_1_Avg", "EC_1_Avg", "T_1_Avg", "VWC_2_Avg", "EC_2_Avg", "T_2_Avg", "VWC_3_Avg", "EC_3_Avg", "T_3_Avg")
SANE = {"BattV": (8.0, 16.0), "VWC": (0.0, 1.2), "EC": (0.0, 5.0), "T": (-20.0, 80.0)}
TIMED = {"BattV": (9.0, 16.0), "VWC": (0.0, 0.6), "EC": (0.0, 5.0), "T": (-40.0, 60.0)}
EPOCH_RANGE = (900_000_000, 1_600_000_000)


def _bounds(ranges: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = zip(*[ranges[f.split("_")[0]] for f in FIELDS])
    return np.array(lo), np.array(hi)


def _windows(block: np.ndarray, size: int) -> np.ndarray:
    """All byte windows of a block of equally long payloads: (rows, offsets, size)."""
    return np.lib.stride_tricks.sliding_window_view(block, size, axis=1)


def _floats(windows: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.ascontiguousarray(windows).view(">f4").astype("float64")


def first_sane(block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset or −1, values) of the first block of ten floats that all lie in range."""
    values = _floats(_windows(block, 40))
    with np.errstate(invalid="ignore"):
        ok = ((values >= lo) & (values <= hi)).all(axis=2)
    at = np.where(ok.any(axis=1), ok.argmax(axis=1), -1)
    return at, values[np.arange(len(block)), np.maximum(at, 0)]


def best_timed(block: np.ndarray, lo: np.ndarray, hi: np.ndarray, scan: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset or −1, epoch seconds, values) of the best record with a quarter-hour time.

    At least eight fields must be in range; more fields win, then the smaller distance outside.
    """
    n, length = block.shape
    first, last = scan or (0, length)
    start, stop = first, max(first, min(length, last) - 43)
    if stop <= start:
        return np.full(n, -1), np.zeros(n, "int64"), np.zeros((n, 10))
    w = np.ascontiguousarray(_windows(block, 44)[:, start:stop])
    seconds = np.ascontiguousarray(w[:, :, :4]).view(">u4")[:, :, 0].astype("int64")
    values = _floats(w[:, :, 4:])
    timed = (seconds >= EPOCH_RANGE[0]) & (seconds <= EPOCH_RANGE[1]) & (seconds % 900 == 0)
    finite = np.isfinite(values)
    with np.errstate(invalid="ignore", over="ignore"):
        inside = finite & (values >= lo) & (values <= hi)
        off = np.where(finite, np.maximum(lo - values, 0) + np.maximum(values - hi, 0), 10.0)
    count, penalty = inside.sum(axis=2), off.sum(axis=2)
    good = timed & (count >= 8)
    # most fields first, then least penalty, then the first offset
    best_count = np.where(good, count, -1).max(axis=1, keepdims=True)
    rank = np.where(good & (count == best_count), penalty, np.inf)
    pick = rank.argmin(axis=1)
    rows = np.arange(n)
    at = np.where(good.any(axis=1), pick + start, -1)
    return at, seconds[rows, pick], values[rows, pick]


def decode_frames(df: DataFrame, keep: Sequence[str], payload: str = "PayloadHex", timed: bool = False, scan: tuple[int, int] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Frames to fields; frames without a plausible record are dropped.

    Hex is unpacked by Spark; each Arrow batch is decoded in blocks of equally long payloads. With
    `timed` the record brings its own time as `epoch_s` (seconds since 1990). The whole payload is
    searched unless `scan` names a range of bytes.
    """
    lo, hi = _bounds(ranges or (TIMED if timed else SANE))
    rows = df.select(*keep, F.try_to_binary(F.regexp_replace(payload, "[ :]", ""), F.lit("hex")).alias("_b")).filter("_b IS NOT NULL")
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + (["epoch_s bigint"] if timed else []) + [f"{f} double" for f in FIELDS])

    need = 44 if timed else 40

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, part in pdf.groupby(pdf["_b"].map(len)):
                if length < need:
                    continue
                # every byte offset becomes a window, so the rows per block follow the payload length
                step = max(1, 200_000 // length)
                for a in range(0, len(part), step):
                    piece = part.iloc[a:a + step]
                    block = np.frombuffer(b"".join(bytes(x) for x in piece["_b"]), dtype="u1").reshape(len(piece), length)
                    out = piece[list(keep)].reset_index(drop=True)
                    if timed:
                        at, seconds, values = best_timed(block, lo, hi, scan)
                        out["epoch_s"] = seconds
                    else:
                        at, values = first_sane(block, lo, hi)
                    for i, f in enumerate(FIELDS):
                        out[f] = values[:, i]
                    yield out[at >= 0]

    return rows.mapInPandas(decode, schema)
