"""Queries of the duplicate operators over `documents`, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, simhash, substring_dedup, suffix_dedup
from .registry import query, table

_SPACE = r"[\x20\x09-\x0D]+"

SUBSTRING_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_SPACE}') IF x <> ''] AS w FROM documents),
win AS (SELECT row_id, doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM t, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 11))) AS i)),
late AS (SELECT row_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT row_id, i + k AS i FROM late, range(0, 13) AS s(k)),
words AS (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
kept AS (SELECT row_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (row_id, i) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row_id)"""


@query("op1_substring_dedup", SUBSTRING_SQL)
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col(substring_dedup.RESULT)
    return substring_dedup.dedup_substrings(docs, with_text=False).select(
        "doc_id", d.n_words.alias("n_words"), d.n_removed.alias("n_removed"), d.kept_sha256.alias("kept_sha256"))


@query("op9_simhash_near_dedup")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


LINES_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT row_id, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n) AS i FROM x WHERE regexp_replace(line, '{_SPACE}', '', 'g') <> ''),
run AS (SELECT row_id, doc_id, i, count(*) OVER r AS c, string_agg(line, chr(10)) OVER r AS g FROM f
  WINDOW r AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {line_dedup.WINDOW - 1} FOLLOWING)),
late AS (SELECT row_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM run WHERE c = {line_dedup.WINDOW}) WHERE k > 1),
gone AS (SELECT DISTINCT row_id, i + k AS i FROM late, range(0, {line_dedup.WINDOW}) AS s(k)),
kept AS (SELECT x.row_id, string_agg(x.line, chr(10) ORDER BY x.n) FILTER (WHERE gone.i IS NULL) AS s,
    count(f.i) AS n_lines, count(gone.i) AS n_removed
  FROM x LEFT JOIN f USING (row_id, n) LEFT JOIN gone ON f.row_id = gone.row_id AND f.i = gone.i GROUP BY x.row_id),
starts AS (SELECT row_id, count(*) AS n_runs FROM (SELECT *, i - lag(i, 1, -9) OVER (PARTITION BY row_id ORDER BY i) AS step FROM gone)
  WHERE step > 1 GROUP BY row_id)
SELECT doc_id, n_lines, n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row_id) LEFT JOIN starts USING (row_id)"""


@query("op4_line_dedup", LINES_SQL)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _told(line_dedup.dedup_lines(docs))


def _told(df: DataFrame) -> DataFrame:
    d = F.col(line_dedup.RESULT)
    return df.select(
        "doc_id", d.n_lines.alias("n_lines"), d.n_removed.alias("n_removed"), d.n_runs.alias("n_runs"),
        F.sha2(d.clean_text, 256).alias("kept_sha256"))


PASSAGES_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT row_id, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n) AS i, len([y FOR y IN regexp_split_to_array(line, '{_SPACE}') IF y <> '']) AS c
  FROM x WHERE regexp_replace(line, '{_SPACE}', '', 'g') <> ''),
run AS (SELECT row_id, doc_id, i, size, count(*) OVER r AS have, sum(c) OVER r AS words, string_agg(line, chr(10)) OVER r AS g
  FROM f, range(1, {line_dedup.WINDOW + 1}) AS s(size)
  WINDOW r AS (PARTITION BY row_id, size ORDER BY i ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING)),
late AS (SELECT row_id, i, size FROM (SELECT *, row_number() OVER (PARTITION BY size, g ORDER BY doc_id, i) AS k FROM run
  WHERE have = size AND (size = {line_dedup.WINDOW} OR words >= {line_dedup.PASSAGE})) WHERE k > 1),
gone AS (SELECT DISTINCT row_id, i + k AS i FROM late, range(0, {line_dedup.WINDOW}) AS s(k) WHERE k < size),
kept AS (SELECT x.row_id, string_agg(x.line, chr(10) ORDER BY x.n) FILTER (WHERE gone.i IS NULL) AS s,
    count(f.i) AS n_lines, count(gone.i) AS n_removed
  FROM x LEFT JOIN f USING (row_id, n) LEFT JOIN gone ON f.row_id = gone.row_id AND f.i = gone.i GROUP BY x.row_id),
starts AS (SELECT row_id, count(*) AS n_runs FROM (SELECT *, i - lag(i, 1, -9) OVER (PARTITION BY row_id ORDER BY i) AS step FROM gone)
  WHERE step > 1 GROUP BY row_id)
SELECT doc_id, n_lines, n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row_id) LEFT JOIN starts USING (row_id)"""


@query("op4_passage_dedup", PASSAGES_SQL)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, or of at least fifty words in one or two."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _told(line_dedup.dedup_lines(docs, words=line_dedup.PASSAGE))


SUFFIX_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, (length(h) // 2)::BIGINT AS n_bytes FROM t),
win AS (SELECT row_id, i, md5(substr(h, 2 * i + 1, 2 * {suffix_dedup.SIZE})) AS g
  FROM n, LATERAL (SELECT unnest(range(0, greatest(0, n_bytes - {suffix_dedup.SIZE - 1}))) AS i)),
told AS (SELECT row_id, i, count(*) OVER (PARTITION BY g) > 1 AS twice,
  (doc_id, i) IS DISTINCT FROM first_value((doc_id, i)) OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS later FROM win JOIN t USING (row_id)),
rep AS (SELECT row_id, i FROM told WHERE twice),
lat AS (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS j FROM told WHERE later),
lats AS (SELECT row_id, sum(least({suffix_dedup.SIZE}, coalesce(j - i, {suffix_dedup.SIZE})))::BIGINT AS n_removed_later FROM lat GROUP BY row_id),
new AS (SELECT *, CASE WHEN i - lag(i) OVER w <= {suffix_dedup.SIZE} THEN 0 ELSE 1 END AS b FROM rep WINDOW w AS (PARTITION BY row_id ORDER BY i)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY row_id ORDER BY i) AS k FROM new),
span AS (SELECT row_id, k, min(i) AS s, max(i) + {suffix_dedup.SIZE} AS e FROM isl GROUP BY row_id, k),
gap AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY row_id ORDER BY s), 0) AS p FROM span),
cut AS (SELECT row_id, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head, max(e) AS tail,
    sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM gap JOIN n USING (row_id) GROUP BY row_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256, coalesce(n_removed_later, 0)::BIGINT AS n_removed_later
FROM n LEFT JOIN cut USING (row_id) LEFT JOIN lats USING (row_id)"""


@query("op6_suffix_dedup", SUFFIX_SQL)
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col(suffix_dedup.RESULT)
    return suffix_dedup.dedup_suffixes(docs, with_text=False, later=True).select(
        "doc_id", d.n_bytes.alias("n_bytes"), d.n_removed.alias("n_removed"), d.n_spans.alias("n_spans"),
        d.kept_sha256.alias("kept_sha256"), d.n_removed_later.alias("n_removed_later"))
