"""Operators for preparing training text: quality, duplicates, contamination, mixing, privacy, toxicity.

Nothing else in the library imports this package; it is registered by `__spark_entry__.py` when present.
"""
