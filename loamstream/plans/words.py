"""Matching by words and by parts of words through postings instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1 << 16


def meet_on_rarest(queries: DataFrame, entries: DataFrame, query_words: str, entry_words: str, hot: int = HOT) -> DataFrame:
    """Pairs of a query and an entry that holds all of the query's words; columns of both, queries taken once each.

    Words are counted over the entries first. A query meets the postings of its rarest word only, and none if an entry
    lacks one of its words altogether. Postings of a word in more than `hot` entries are dealt to parts, and the
    queries that still need it go to each part, so no word's postings are in one task.
    """
    posted = entries.withColumn("_w", F.explode(F.array_distinct(entry_words)))
    count = posted.groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    asked = queries.withColumn("_w", F.explode(F.array_distinct(query_words))).join(count, "_w", "left")
    rare = asked.groupBy(*queries.columns).agg(F.min(F.struct("_df", "_w")).alias("_r"), F.count_if(F.col("_df").isNull()).alias("_lost")).filter("_lost = 0")
    parts = lambda df: F.ceil(df / F.lit(hot)).cast("int")
    left = rare.select(*queries.columns, F.col("_r._w").alias("_w"), F.explode(F.sequence(F.lit(0), parts(F.col("_r._df")) - 1)).alias("_s"))
    busy = count.filter(F.col("_df") > hot)
    right = posted.join(busy, "_w", "left").withColumn(
        "_s", F.coalesce(F.pmod(F.xxhash64(*entries.columns), parts(F.col("_df"))), F.lit(0)).cast("int")).drop("_df")
    return left.join(right, ["_w", "_s"]).filter(F.size(F.array_except(query_words, entry_words)) == 0).drop("_w", "_s")


def grams(c: Column, n: int) -> Column:
    """Different parts of `n` characters; the whole text where it is shorter."""
    return F.when(F.length(c) <= n, F.array(c)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))))


def prefixes(c: Column) -> Column:
    """All beginnings of a text, the whole included; none of an empty one."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n)))
