"""Imports every query module of the package so that its registry is complete."""

from . import queries_contamination, queries_dedup, queries_mixing, queries_neighbours, queries_privacy, queries_quality, queries_search, queries_sources, queries_tokens, queries_toxicity  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
