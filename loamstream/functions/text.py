"""Name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens rewritten before punctuation is collapsed
MACHINE_TOKENS = (
    ("%", "pct"),
    ("meq/100g", "meq_100g"),
    ("me/100g", "me_100g"),
    ("mg/kg", "mg_kg"),
)

# fixed values: unit endings spelled out when a column name is shown to people
HUMAN_TOKENS = (
    ("_pct_db", " percent dry basis"),
    ("_pctndf_db", " percent ndf dry basis"),
    ("_pct", " percent"),
    ("_ppm", " ppm"),
    ("_meq_100g", " meq per 100g"),
    ("_me_100g", " meq per 100g"),
    ("_lb_per_acre", " pounds per acre"),
    ("_total_lb", " total pounds"),
    ("_biomass", " biomass"),
    ("_ratio", " ratio"),
    ("_rec", " recommendation"),
    ("_", " "),
)


def _replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def machine_name(c: Column) -> Column:
    """`CEC/Sum of Cations me/100g` to `cec_sum_of_cations_me_100g`."""
    s = _replace_all(F.lower(F.trim(c)), MACHINE_TOKENS)
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case, every run of other characters one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_line(c: Column) -> Column:
    """Looser form for searching running text: percent signs stay, joiners become blanks."""
    s = F.regexp_replace(F.lower(c), r"[_\-/]+", " ")
    s = F.regexp_replace(s, "[^a-z0-9% ]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalize_lines(c: Column) -> Column:
    """The same for a whole text at once; line breaks (`\\n`) stay where they are."""
    s = F.regexp_replace(F.lower(c), r"[_\-/]+", " ")
    s = F.regexp_replace(s, r"[^a-z0-9%\n]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r" *\n *", "\n"), "^ +| +$", "")


def human_name(c: Column) -> Column:
    return normalize_text(_replace_all(c, HUMAN_TOKENS))
