"""Query of private data over `documents`. SQL cannot fit trees; tests hold base spans against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .private_data import KINDS, find_private, spelled
from .registry import query, table


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


@query("op8_private_data")
def private(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_private(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, spans = F.col("private.base"), F.col("private.spans")
    counts = [_count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"), F.size(spans).cast("long").alias("n_private"))
