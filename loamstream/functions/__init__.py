"""Column expressions: numbers, units, names and geometry."""

from .numbers import bounded, div, nan_to_null, number, padded_range, safe_ratio
from .text import machine_name, normalize_text
from .units import converted, distance_ft, to_celsius, to_fahrenheit

__all__ = [
    "bounded", "converted", "distance_ft", "div", "machine_name", "nan_to_null", "normalize_text",
    "number", "padded_range", "safe_ratio", "to_celsius", "to_fahrenheit",
]
