"""Cutting lineage in the cluster's shared folder, and connected components of sparse links."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir

LINKS = 1 << 16


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of df but those whose names an operator uses itself (case aside, as Spark resolves names)."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def cols(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def text_hash(text: str) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that `spark.checkpoint.dir` names; lost executors do not matter."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder, for rows too many for a checkpoint's plain form."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of few bytes for the jobs that run inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node can reach. Alternating large and small stars.

    Every step keeps one row per link, whatever the size of a component: a node only learns the
    smallest of its neighbours. The number of rounds grows with the logarithm of the longest chain.
    A round has one task per `LINKS` links, not one per shuffle partition: each round writes files
    per task, and a few links dealt over many tasks fill the disk with nearly empty ones.
    """
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while True:
        few = 1 + state[0] // LINKS
        both = edges.coalesce(few).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small.filter("u <> v").coalesce(few).distinct().coalesce(few))
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sums of the links: equal before and after a round that changes nothing."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
