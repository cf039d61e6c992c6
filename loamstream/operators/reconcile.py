"""Comparing two copies of a series, columns and blocks of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import div
from ..plans import column_quantiles, exact_quantiles, null_safe_join
from ..session import cut_lineage
from .resample import QUARTILES, bin_of

# fixed value
GALLONS_PER_ACRE_FT = 325851.0


def _stack(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields
    ])).alias("_f")).select(*keys, "_f.field", f"_f.{name}")


def compare_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], tol: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coverage, largest difference per field, outliers) of two sources with unique keys."""
    left = a.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    in_a, in_b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    coverage = both.agg(
        F.count_if(in_a & in_b).alias("overlap_count"), F.count_if(in_a & ~in_b).alias("only_left"),
        F.count_if(in_b & ~in_a).alias("only_right"),
    )
    pairs = both.filter(in_a & in_b).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").cast("double").alias("left_value"), F.col(f"_b_{f}").cast("double").alias("right_value"))
        for f in fields])).alias("_f")).select(*keys, "_f.*").withColumn("abs_delta", F.abs(F.col("left_value") - F.col("right_value")))
    deltas = pairs.groupBy("field").agg(F.coalesce(F.max("abs_delta"), F.lit(0.0)).alias("max_abs_delta"))
    return coverage, deltas, pairs.filter(F.col("abs_delta") > tol)


def time_align(a: DataFrame, b: DataFrame, grain: str, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Both sides averaged to common bins and joined, with difference and relative error."""
    def means(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, bin_of(ts, grain).alias("bin")).agg(F.avg(value).alias(name))

    joined = means(a, "left_value").join(means(b, "right_value"), [*keys, "bin"])
    delta = F.col("right_value") - F.col("left_value")
    return joined.withColumns({"delta": delta, "rel_err": div(delta, F.col("left_value"))})


def error_summary(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = F.col("delta")
    return aligned.filter(d.isNotNull()).groupBy(*keys).agg(
        F.count(d).alias("count"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("std_delta"),
    )


ERROR_QUANTILES = {"abs_rel_err_p50": 0.5, "abs_rel_err_p95": 0.95, "abs_rel_err_p99": 0.99}


def error_quality(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative-error quantiles, shares within 0.5, 1 and 2 %, and a verdict."""
    rows = aligned.filter(F.col("rel_err").isNotNull()).withColumn("_r", F.abs("rel_err"))
    r = F.col("_r")
    base = rows.groupBy(*keys).agg(
        F.count(r).alias("n_overlap"), F.max(r).alias("abs_rel_err_max"),
        F.avg((r <= 0.005).cast("double")).alias("share_within_0p5pct"),
        F.avg((r <= 0.01).cast("double")).alias("share_within_1pct"),
        F.avg((r <= 0.02).cast("double")).alias("share_within_2pct"),
    )
    out = null_safe_join(base, exact_quantiles(rows, keys, "_r", ERROR_QUANTILES), keys)
    p95 = F.col("abs_rel_err_p95")
    good = (p95 <= 0.01) & (F.col("share_within_0p5pct") >= 0.90)
    check = (p95 > 0.02) | (F.col("share_within_1pct") < 0.95)
    return out.withColumn("flag", F.when(good, "GOOD").when(check, "CHECK").otherwise(""))


def magnitude_compare(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Ratio and difference of every descriptive statistic of the common fields."""
    def stats(df: DataFrame, side: str) -> DataFrame:
        rows = _stack(df, [], fields, "v")
        base = rows.filter("v IS NOT NULL").groupBy("field").agg(
            F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        out = base.join(exact_quantiles(rows, ["field"], "v", QUARTILES), "field")
        return out.select("field", *[F.col(c).alias(f"{side}_{c}") for c in names])

    names = ("mean", "std", "min", "p25", "p50", "p75", "max")
    joined = stats(a, "left").join(stats(b, "right"), "field")
    return joined.select(
        "field", *[div(F.col(f"right_{c}"), F.col(f"left_{c}")).alias(f"ratio_{c}") for c in names],
        *[(F.col(f"right_{c}") - F.col(f"left_{c}")).alias(f"absdiff_{c}") for c in names])


def column_signatures(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One fingerprint per column over all (row key, text) cells.

    Cells are hashed twice and the hashes are added up, so partial fingerprints combine on the map side
    and repeated rows count as often as they occur. NULL differs from empty text.
    """
    cells = df.select(F.col(key).cast("string").alias("_k"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = cells.unpivot(["_k"], list(columns), "column", "cell")

    def total(*parts: Column) -> Column:
        return F.sum(F.xxhash64(*parts, F.col("_k").isNull(), F.col("cell").isNull()).cast("decimal(28,0)"))

    return long.groupBy("column").agg(
        total(F.col("_k"), F.col("cell")).alias("_h1"), total(F.lit("b"), F.col("cell"), F.col("_k")).alias("_h2"),
        F.count(F.lit(1)).alias("_n"))


def match_columns(old: DataFrame, new: DataFrame, key: str, old_columns: Sequence[str], new_columns: Sequence[str]) -> DataFrame:
    """Which column of the new table holds an old column's values: mapped, ambiguous or unmapped."""
    marks = ["_h1", "_h2", "_n"]
    a = column_signatures(old, key, old_columns).withColumnRenamed("column", "old_column")
    # a table has few columns; one row per signature keeps the join from pairing anything
    b = column_signatures(new, key, new_columns).groupBy(*marks).agg(F.array_sort(F.collect_list("column")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return a.join(b, marks, "left").select(
        "old_column", F.concat_ws(",", "candidates").alias("candidates"),
        F.when(F.col("candidates").isNull(), "unmapped").when(n == 1, "mapped").otherwise("ambiguous").alias("status"))


def duplicate_blocks(df: DataFrame, keys: Sequence[str], pos: str = "pos", line: str = "line") -> DataFrame:
    """Largest block of consecutive lines that occurs twice in a file, per file.

    Columns: keys, first_start, second_start, block_len; files without a repeated line are absent.
    Lengths are found by doubling: a position survives a level only if the hash of its next 2^k
    lines occurs twice in the file, and hashes of longer blocks are made of two shorter ones by an
    equi-join on position. Work and data shrink with each level, no pair of lines is ever formed,
    and the number of levels is the logarithm of the longest repeat. Positions must run without gaps.
    """
    ks = list(keys)
    base = df.select(*ks, F.col(pos).cast("bigint").alias("_p"), F.xxhash64(F.col(line)).alias("_a"), F.xxhash64(F.lit("b"), F.col(line)).alias("_b"))
    base = cut_lineage(base)

    def repeated(rows: DataFrame) -> DataFrame:
        twice = rows.groupBy(*ks, "_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        return rows.join(twice, [*ks, "_a", "_b"], "left_semi")

    def extend(head: DataFrame, tail: DataFrame, by: int) -> DataFrame:
        """Hash of `head` followed by `tail`, where tail begins `by` lines later."""
        shifted = tail.select(*ks, (F.col("_p") - by).alias("_p"), F.col("_a").alias("_ta"), F.col("_b").alias("_tb"))
        return head.join(shifted, [*ks, "_p"]).select(
            *ks, "_p", F.xxhash64("_a", "_ta").alias("_a"), F.xxhash64("_b", "_tb").alias("_b"))

    levels = [cut_lineage(repeated(base))]
    while not levels[-1].isEmpty():
        levels.append(cut_lineage(repeated(extend(levels[-1], levels[-1], 1 << (len(levels) - 1)))))
    levels.pop()
    if not levels:
        return df.select(*ks).limit(0).withColumns({c: F.lit(0).cast("bigint") for c in ("first_start", "second_start", "block_len")})

    # per file: lengthen the longest known repeat by falling powers of two while it still repeats
    top = len(levels) - 1
    reached = [levels[k].select(*ks).distinct().withColumn("_k", F.lit(k)) for k in range(top + 1)]
    best = reached[0]
    for r in reached[1:]:
        best = best.unionByName(r)
    best = best.groupBy(*ks).agg(F.max("_k").alias("_top"))
    current = levels[0].join(best.filter("_top = 0"), ks).withColumn("_len", F.lit(1).cast("bigint"))
    for k in range(1, top + 1):
        current = current.unionByName(levels[k].join(best.filter(F.col("_top") == k), ks).withColumn("_len", F.lit(1 << k).cast("bigint")))
    current = cut_lineage(current.select(*ks, "_p", "_a", "_b", "_top", "_len"))
    for k in range(top - 1, -1, -1):
        tail = levels[k].select(*ks, F.col("_p").alias("_q"), F.col("_a").alias("_ta"), F.col("_b").alias("_tb"))
        grown = current.filter(F.col("_top") > k).withColumn("_q", F.col("_p") + F.col("_len")).join(tail, [*ks, "_q"]).select(
            *ks, "_p", F.xxhash64("_a", "_ta").alias("_a"), F.xxhash64("_b", "_tb").alias("_b"), "_top", (F.col("_len") + (1 << k)).alias("_len"))
        longer = cut_lineage(repeated(grown))
        stay = current.join(longer.select(*ks).distinct(), ks, "left_anti")
        current = cut_lineage(stay.unionByName(longer))

    # the first line's earliest occurrence, then the earliest start, decides among equal lengths
    first = levels[0].groupBy(*ks, F.col("_a").alias("_la"), F.col("_b").alias("_lb")).agg(F.min("_p").alias("_first"))
    lines = levels[0].select(*ks, "_p", F.col("_a").alias("_la"), F.col("_b").alias("_lb"))
    groups = current.join(lines, [*ks, "_p"]).groupBy(*ks, "_a", "_b", "_la", "_lb", "_len").agg(F.min("_p").alias("_s1"))
    second = current.join(groups.select(*ks, "_a", "_b", "_s1"), [*ks, "_a", "_b"]).filter(F.col("_p") > F.col("_s1")).groupBy(
        *ks, "_a", "_b").agg(F.min("_p").alias("_s2"))
    found = groups.join(second, [*ks, "_a", "_b"]).join(first, [*ks, "_la", "_lb"])
    pick = F.min(F.struct("_first", "_s1", "_s2", "_len")).alias("_m")
    return found.groupBy(*ks).agg(pick).select(
        *ks, F.col("_m._s1").alias("first_start"), F.col("_m._s2").alias("second_start"), F.col("_m._len").alias("block_len"))


def drop_block(df: DataFrame, blocks: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Rows without the second copy of each file's repeated block."""
    out = null_safe_join(df, blocks.select(*keys, "second_start", "block_len"), keys, "left")
    inside = (F.col(pos) >= F.col("second_start")) & (F.col(pos) < F.col("second_start") + F.col("block_len"))
    return out.filter(~F.coalesce(inside, F.lit(False))).select(*df.columns)


def reconcile_volume(df: DataFrame, volume: str = "gallons_group", acre_ft: str = "acre_ft", tol: float = 0.15) -> DataFrame:
    """Volume against acre-feet: about twice is halved, more than `tol` off is a mismatch."""
    if volume == "gallons_strip":
        raise ValueError("reconcile group volumes, not strip volumes")
    expected = F.when(F.col(acre_ft) > 0, F.col(acre_ft) * F.lit(GALLONS_PER_ACRE_FT))
    v = F.col(volume)
    ratio = v / expected
    twice = F.coalesce(ratio.between(1.9, 2.1), F.lit(False))
    off = F.coalesce(F.abs(v - expected) / expected > tol, F.lit(False))
    return df.withColumn("volume_check", F.when(twice, "halved").when(off, "mismatch").otherwise("ok")).withColumn(
        volume, F.when(twice, v / 2.0).otherwise(v))
