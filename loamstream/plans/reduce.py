"""Reductions that combine on the map side, so one hot key does not land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one that is last by `order`; a reduction, not a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First `n` rows per key; Spark cuts each map task to `n` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pair_values(
    df: DataFrame,
    keys: Sequence[str],
    member: str,
    pairs: Sequence[tuple[str, str]],
    value: Column | str = "value",
) -> DataFrame:
    """Treated and control value side by side per key and pair, without a self-join.

    A member belongs to exactly one pair, so the pair is a lookup and both values come from one
    conditional aggregation. Result: keys, treated, control, treated_value, control_value.
    """
    value = F.col(value) if isinstance(value, str) else value
    lookup = F.create_map(
        *[F.lit(x) for a, b in pairs for x in (a, a, b, a)]
    )
    partner = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    tagged = df.withColumn("treated", lookup[F.col(member)]).filter(F.col("treated").isNotNull())
    is_treated = F.col(member) == F.col("treated")
    return (
        tagged.groupBy(*keys, "treated")
        .agg(
            F.max(F.when(is_treated, value)).alias("treated_value"),
            F.max(F.when(~is_treated, value)).alias("control_value"),
        )
        .withColumn("control", partner[F.col("treated")])
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the right side's keys are dropped."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


SLICES = 256


def _value_slices(counted: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """Rows (keys, _v, _n) with `_slice`, which never falls as `_v` rises, and the key's `_total`.

    The slices come from the data: a mergeable quantile sketch of each key's different values gives the cuts, so a
    slice holds about one of `slices` parts of them, however close the values lie. The place of a value among the
    cuts is found by halving.
    """
    shares = [i / slices for i in range(1, slices)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", shares, 4 * slices).alias("_cuts"), F.sum("_n").alias("_total"))
    out = null_safe_join(counted, cuts, keys).withColumn("_slice", F.lit(0))
    step = slices // 2
    while step:
        ahead = F.element_at("_cuts", F.col("_slice") + step) < F.col("_v")
        out = out.withColumn("_slice", F.col("_slice") + F.when(ahead, step).otherwise(0))
        step //= 2
    return out.drop("_cuts")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Exact interpolated quantiles per key, spread over slices of the key's own values.

    Equal values are counted before the shuffle; a table with one row per (key, value slice) tells
    which slices hold the wanted ranks, and only those slices are ordered. No task ever holds all
    values of a key. Keys without values give no row. `weight` says how often a row's value counts;
    `slices` is a power of two.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    counted = _value_slices(counted, keys, slices)
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        counted.groupBy(*keys, "_slice", "_total").agg(F.sum("_n").alias("_m"))
        .select(*keys, "_slice", "_m", F.sum("_m").over(upto).alias("_cum"), "_total")
        .withColumn("_base", F.col("_cum") - F.col("_m"))
    )
    ranks = F.flatten(F.array(*[
        F.array(F.floor((F.col("_total") - 1) * F.lit(p)), F.ceil((F.col("_total") - 1) * F.lit(p)))
        for p in probs.values()
    ]))
    wanted = hist.withColumn(
        "_ranks",
        F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_cum")))),
    ).filter(F.size("_ranks") > 0).select(*keys, "_slice", "_base", "_ranks")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    hits = (
        null_safe_join(counted, wanted, [*keys, "_slice"])
        .withColumn("_hi", F.col("_base") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))))
        .select(*keys, "_v", "_total", F.explode("_ranks").alias("_rank"))
    )
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(p)
        lo = F.max(F.when(F.col("_rank") == F.floor(pos), F.col("_v")))
        hi = F.max(F.when(F.col("_rank") == F.ceil(pos), F.col("_v")))
        frac = F.max(pos - F.floor(pos))
        out.append((lo + (hi - lo) * frac).alias(name))
    return hits.groupBy(*keys).agg(*out)


def column_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float],
) -> DataFrame:
    """Exact quantiles of several columns in one pass, named `{prob}_{column}`; all-NULL stays NULL.

    The columns are stacked, so one set of shuffles serves them all.
    """
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in columns
    ])).alias("_m")).select(*keys, "_m._c", "_m._x")
    found = exact_quantiles(stacked, [*keys, "_c"], "_x", probs)
    wide = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_c") == c, F.col(p))).alias(f"{p}_{c}") for p in probs for c in columns
    ])
    return null_safe_join(df.select(*keys).distinct(), wide, keys, "left")
