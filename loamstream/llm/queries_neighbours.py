"""Query of the quality classifier over `documents`. SQL cannot decompose matrices; tests hold it against held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_neighbours import RESULT, score_quality
from .registry import query, table


@query("op13_quality_neighbours")
def quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held)
    return score_quality(docs, labels).select(
        "doc_id", held.alias("held_out"), F.col(RESULT).alias("score"), F.when(F.col(RESULT) >= 0.3, 1).otherwise(0).alias("predicted"))
