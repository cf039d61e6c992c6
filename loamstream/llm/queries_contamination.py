"""Query of benchmark decontamination over `documents` and `benchmark`, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (_UPPER, _LOWER)

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, array_to_string(w[i:i+least(10, len(w))-1], ' ') AS g, least(10, len(w)) AS n
  FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrase),
win AS (SELECT row_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM d, lengths,
  LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT row_id, i, phrase.n, item_id FROM win JOIN phrase ON win.g = phrase.g AND win.n = phrase.n),
words AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY row_id),
items AS (SELECT row_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)"""


@query("op10_decontaminate", SQL)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    c = F.col("contamination")
    return found.select(
        "doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c.n_hit > 0).alias("contaminated"))
