"""Query of mixing over `documents`. SQL has no fixed point to rake to; tests hold it against a plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix
from .registry import query, table


@query("op3_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "copies")
