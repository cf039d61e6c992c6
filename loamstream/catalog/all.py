"""Imports every query module so that the registry is complete."""

from . import cleaning, health, records, response, seasonal, serving, storage, timing, trial  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
