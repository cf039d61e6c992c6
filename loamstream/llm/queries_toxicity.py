"""Query of toxicity over `documents`. SQL cannot decode lattices; tests hold it against held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .toxicity import score_toxicity


@query("op5_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    return score_toxicity(docs, labels).select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
