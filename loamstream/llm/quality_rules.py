"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and every threshold is a built-in column expression, so a document is judged where it
is read: no shuffle, no user function, no second pass. Work per document is at most n log n in its
words (the sort that finds repeated word windows).

Defined results: a null text counts as empty (0 words, base failed); an empty text fails the base
rule; repeated rows are judged alike, each on its own; other columns pass through untouched, and
those that clash with a measure's name are replaced by the measure, and working names (WORKING) are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cols, others

SPACE_RE = r"[\x20\x09-\x0D]+"
NO_SPACE_RE = r"[^\x20\x09-\x0D]"
SYMBOLS_RE = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "on", "for", "was",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "qui", "dans", "pour", "sur", "au",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "nicht", "ein", "zu", "auf", "als", "im",
    "el", "los", "las", "y", "se", "del", "por", "con", "su", "no", "lo", "al", "una",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; None leaves a side open. A null measure passes.

    The rule speaks only of documents of `min_words` words or more: ratios of short texts are noise.
    """

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# The production table. Ratios are per word or per line that has a word.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_ratio", high=0.10),
    Rule("dup_line_ratio", high=0.35),
    Rule("repeat_word_ratio", high=0.20),
    Rule("upper_word_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.04, min_words=30),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the ratios the rules use. Intermediate arrays are dropped again."""
    raw = F.coalesce(F.col(text), F.lit(""))
    keep = cols(others(docs, *MEASURES, *WORKING))
    df = docs.select(
        *keep,
        raw.alias("_t"),
        F.filter(F.split(raw, SPACE_RE), lambda w: w != "").alias("_w"),
        F.filter(F.split(raw, "\n"), lambda x: x.rlike(NO_SPACE_RE)).alias("_l"),
    )
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS_RE)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_l")).cast("long").alias("_dl"),
        _window_hashes("_w").alias("_g"),
    )
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    df = df.select(
        "*",
        (F.col("n_lines") - F.col("_dl")).alias("n_dup_lines"),
        _repeated_words("_w", "_g").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper_words"),
    )
    # inline() keeps later filters from being pushed below, where each measure would be computed anew
    return df.select(*keep, F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_word_ratio"),
        (F.col("n_upper_words") / words).alias("upper_word_ratio"),
        (F.col("n_stop_words") / words).alias("stop_word_ratio"),
    ))))


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "mean_word_chars",
    "symbol_ratio", "dup_line_ratio", "repeat_word_ratio", "upper_word_ratio", "stop_word_ratio",
)


WORKING = ("_t", "_w", "_l", "_g", "_dl", "n_stop_words", "n_upper_words", "base_failed", "kept")


def _starts(words: str) -> Column:
    n = F.size(words)
    return F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))


def _window_hashes(words: str) -> Column:
    """A hash per window: where all differ no window repeats, and nothing dearer need be made."""
    return F.transform(_starts(words), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(WINDOW)]))


def _windows(words: str) -> Column:
    """All windows of WINDOW words, joined by a space (words have none, so the text is the sequence)."""
    return F.transform(_starts(words), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(WINDOW))))


def _repeated_words(words: str, hashes: str) -> Column:
    """Words covered by windows that occur twice or more. Texts whose window hashes all differ have none."""
    ranked = F.sort_array(F.transform(_windows(words), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # the sorted array is bound once, by an outer transform over one element
    starts = F.element_at(F.transform(F.array(ranked), lambda r: F.sort_array(F.filter(
        F.transform(r, lambda x, k: F.when(
            (x["w"] == F.get(r, k - 1)["w"]) | (x["w"] == F.get(r, k + 1)["w"]), x["i"])),
        lambda i: i.isNotNull()))), 1)
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + (i + WINDOW - F.greatest(a["end"], i))).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def passes(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression."""
    tests = []
    for r in rules:
        c, short = F.col(r.measure), F.col("n_words") < r.min_words
        if r.low is not None:
            tests.append(F.coalesce(c >= r.low, F.lit(True)) | short)
        if r.high is not None:
            tests.append(F.coalesce(c <= r.high, F.lit(True)) | short)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns, the measures, `base_failed` and `kept`.

    Base rule: fewer than 10 words, or over 20 % of the words in repeated windows. What fails it is
    never kept, whatever the table says.
    """
    df = measures(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & passes(rules))
