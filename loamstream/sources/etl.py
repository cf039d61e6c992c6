"""From logger lines to stored summaries in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..fixed_values import BOUNDS, CLOCK_STEPS
from ..operators import clean
from ..operators.resample import resample
from ..operators.timeops import correct_clock
from ..schema import SERIES
from .summary import write_summary
from .textfiles import read_toa5


def clean_readings(
    lines: DataFrame, steps: Mapping[str, Sequence[tuple[str, int]]] = CLOCK_STEPS, rules: clean.Rules = BOUNDS,
) -> DataFrame:
    """Readings of logger lines with their clock put right, one per instant, in their units and bounds.

    A missing cell is no reading, so it never hides an earlier one; of readings of one instant the last
    in file order stays. Everything but that reduction is a projection.
    """
    known = correct_clock(lines.filter("value IS NOT NULL"), steps)
    once = clean.dedupe_last(known, [*SERIES, "ts"], ["file", "block", "line_id"])
    return clean.enforce_bounds(clean.scale_units(clean.mask_sentinels(once)), rules)


def store_summaries(
    spark: SparkSession, path: str, root: str, grains: Sequence[str] = ("daily",), tag_pattern: str = r"(S\d)([TMB])[^/]*$",
    steps: Mapping[str, Sequence[tuple[str, int]]] = CLOCK_STEPS,
) -> DataFrame:
    """Read logger files, clean them and write a summary per granularity; returns the rejected lines."""
    good, rejects = read_toa5(spark, path, tag_pattern)
    rows = clean_readings(good, steps)
    for grain in grains:
        write_summary(resample(rows, grain), root, grain)
    return rejects
