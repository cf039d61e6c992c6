"""Reusable plan shapes: time slices, ordered scans over slices, range and nearest joins."""

from .ordered import flag_runs, gap_sessions, lag_in_time, lag_where, last_known_before, running_total, true_runs
from .ranges import interval_join, latest_before, nearest_join, range_max
from .reduce import (
    column_quantiles, exact_quantiles, keep_latest, null_safe_join, pair_values, top_rows,
)
from .slices import micros, seconds_between, slice_of

__all__ = [
    "column_quantiles", "null_safe_join",
    "exact_quantiles", "flag_runs", "gap_sessions", "interval_join", "keep_latest", "lag_in_time", "lag_where", "last_known_before", "latest_before", "micros",
    "nearest_join", "pair_values", "range_max", "running_total", "seconds_between", "slice_of", "top_rows",
    "true_runs",
]
