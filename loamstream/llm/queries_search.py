"""Query of ranked lexical search of `benchmark` items in `documents`, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lexical_search import search_documents
from .registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{_UPPER}', '{_LOWER}')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
occ AS (SELECT row_id, {_WORDS} AS t FROM d),
len AS (SELECT row_id, count(*)::HUGEINT AS n FROM occ GROUP BY row_id),
tot AS (SELECT count(*)::HUGEINT AS nd, sum(n)::HUGEINT AS nt FROM len),
b AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
qt AS (SELECT q, {_WORDS} AS t FROM b),
tf AS (SELECT row_id, t, count(*) AS tf FROM occ SEMI JOIN qt USING (t) GROUP BY row_id, t),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::HUGEINT AS w FROM tf, tot GROUP BY t, nd),
gain AS (SELECT row_id, t, w * ((1000000000::HUGEINT * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS g
  FROM tf JOIN len USING (row_id) JOIN w USING (t), tot),
s AS (SELECT q, row_id, sum(g) AS score FROM qt JOIN gain USING (t) GROUP BY q, row_id),
r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN d USING (row_id) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM r JOIN b USING (q) WHERE rank <= 20"""


@query("op12_lexical_search", SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
