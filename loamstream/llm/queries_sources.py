"""Query of the source divergence audit over `documents`, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .source_audit import audit_sources

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT row_id, lang, source, unnest(w) AS t FROM d),
voc AS (SELECT lang, t, count(*) AS c FROM occ GROUP BY lang, t HAVING count(DISTINCT row_id) >= 3),
lng AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM voc GROUP BY lang),
cnt AS (SELECT lang, source, t, count(*) AS c FROM occ SEMI JOIN voc USING (lang, t) GROUP BY lang, source, t),
tot AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, t, coalesce(cnt.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 1)) // (tot.n + lng.v) AS p,
  1 + (1000000000::HUGEINT * (voc.c + 1)) // (lng.n + lng.v) AS q
  FROM tot JOIN voc USING (lang) JOIN lng USING (lang) LEFT JOIN cnt USING (lang, source, t)),
pair AS (SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b USING (lang, t) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
word AS (SELECT lang, source, 'term' AS part, t AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM word))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op11_source_audit", SQL)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))
