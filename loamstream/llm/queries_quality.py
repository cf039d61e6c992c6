"""Query of the quality rules over `documents`, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules as rules
from .registry import query, table

_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


def _rule_sql(r: rules.Rule) -> str:
    tests = [f"{r.measure} >= {r.low}"] if r.low is not None else []
    tests += [f"{r.measure} <= {r.high}"] if r.high is not None else []
    return f"(n_words < {r.min_words} OR coalesce({' AND '.join(tests)}, true))"


_SPACE = "[\\x20\\x09-\\x0D]+"
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '{_SPACE}') IF x <> ''] AS w,
    [x FOR x IN string_split(t, chr(10)) IF regexp_replace(x, '{_SPACE}', '', 'g') <> ''] AS l FROM t),
win AS (SELECT row_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT row_id, i FROM win QUALIFY count(*) OVER (PARTITION BY row_id, g) > 1),
cov AS (SELECT row_id, count(DISTINCT i + k)::BIGINT AS n FROM rep, range(0, 5) AS s(k) GROUP BY row_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len([x FOR x IN w IF upper(x) = x AND lower(x) <> x]) AS n_upper_words,
    len([x FOR x IN w IF lower(x) IN ({_STOP})]) AS n_stop_words
  FROM w LEFT JOIN cov USING (row_id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_repeat_words / nullif(n_words, 0) AS repeat_word_ratio,
    n_upper_words / nullif(n_words, 0) AS upper_word_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule_sql(r) for r in rules.RULES)} AS kept
FROM r"""


@query("op2_quality_rules", SQL)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
