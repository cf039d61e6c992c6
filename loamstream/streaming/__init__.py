"""Incremental jobs on Structured Streaming; event time is TIMESTAMP, results are TIMESTAMP_NTZ."""
