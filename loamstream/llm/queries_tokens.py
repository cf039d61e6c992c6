"""Query of token counts over `documents`. SQL cannot encode text; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .token_counts import histogram, suffix_sums


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(table(spark, sf_dir, "documents")))
