"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loamstream.llm import decontaminate, line_dedup, mixing, private_data, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts, toxicity

LONG = "Lorem ipsum word " * 20_000
ROWS = [
    (1, "alpha beta gamma delta\nsecond line here\nthird line here\nfourth", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "alpha beta gamma delta\nsecond line here\nthird line here\nfourth", "en", "b"),
    (4, "same row", "de", "b"),
    (4, "same row", "de", "b"),
    (5, LONG, "en", "b"),
    (6, " \t\n\r ", "en", "a"),
    (7, "é" * 500 + "\U0001F600", "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n_words", "KEPT", "dedup", "simhash", "_block", "_id", "_t", "_w", "base", "weight", "copies", "topic", "toxicity",
         "private", "contamination", "line_dedup", "suffix_dedup", "_s", "_source", "extra")


def _items(spark):
    return spark.createDataFrame([(1, "beta gamma"), (1, "delta"), (2, None), (3, ""), (None, "second line")], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (4, 0)], "doc_id long, toxic int")


OPERATORS = {
    "substring": lambda s, d: substring_dedup.dedup_substrings(d, k=3),
    "quality": lambda s, d: quality_rules.judge(d),
    "mixing": lambda s, d: mixing.mix(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, _labels(s)),
    "suffix": lambda s, d: suffix_dedup.dedup_suffixes(d),
    "fingerprints": lambda s, d: simhash.fingerprints(d),
    "near": lambda s, d: simhash.near_duplicates(d),
    "private": lambda s, d: private_data.find_private(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, _items(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_comes_back(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("other"))
    out = OPERATORS[name](spark, docs)
    lower = [c.lower() for c in out.columns]
    assert len(lower) == len(set(lower))
    got = sorted(r[0] if r[0] is not None else -1 for r in out.select("doc_id").collect())
    assert got == sorted(r[0] if r[0] is not None else -1 for r in ROWS)
    if name != "near":
        assert out.select("extra").distinct().collect()[0][0] == "other"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = hashlib.sha256(b"").hexdigest()
    sub = {(r.doc_id, r.text): r.dedup for r in OPERATORS["substring"](spark, docs).collect()}
    assert sub[2, None].n_words == 0 and sub[3, ""].kept_sha256 == none
    assert sub[1, ROWS[0][1]].n_removed == 0 and sub[None, ROWS[3][1]].n_removed == 11  # null comes last
    assert sub[4, "same row"].n_removed == 0  # one id, no smaller one
    assert sub[5, LONG].n_removed == 0  # repeats inside one document stay
    lines = {(r.doc_id, r.text): r.line_dedup for r in OPERATORS["lines"](spark, docs).collect()}
    assert lines[1, ROWS[0][1]].n_removed == 0 and lines[None, ROWS[3][1]].clean_text == ""
    near = OPERATORS["near"](spark, docs).collect()
    zero = {r.component_id for r in near if r.simhash == 0}
    assert zero == {2} and {r.doc_id for r in near if r.simhash == 0} == {2, 3, 6}
    tox = OPERATORS["toxicity"](spark, docs.filter("doc_id in (2, 3)")).collect()
    assert {r.toxicity for r in tox} == {0.0}
    mix = OPERATORS["mixing"](spark, docs.filter("doc_id in (2, 3)")).collect()
    assert {(r.weight, r.copies) for r in mix} == {(1.0, 1)}
    cont = {(r.doc_id, r.text): r.contamination for r in OPERATORS["decontaminate"](spark, docs).collect()}
    assert cont[1, ROWS[0][1]].n_hit == 5 and cont[1, ROWS[0][1]]["items"] == ["1"] and cont[2, None].n_words == 0
    suf = {(r.doc_id, r.text): r.suffix_dedup for r in OPERATORS["suffix"](spark, docs).collect()}
    assert suf[5, LONG].n_removed == len(LONG) and suf[4, "same row"].n_removed == 0 and suf[2, None].n_bytes == 0
    assert suf[7, ROWS[8][1]].n_bytes == 1004 and suf[7, ROWS[8][1]].n_removed == 1000
    q = {(r.doc_id, r.text): r for r in OPERATORS["quality"](spark, docs).collect()}
    assert q[2, None].base_failed and not q[2, None].kept and q[3, ""].n_words == 0 and q[5, LONG].n_repeat_words == 60_000


def test_empty_token_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    sums = token_counts.suffix_sums(token_counts.histogram(docs))
    assert sums.collect() == [] and token_counts.quantiles(sums, [0.5]).first().n_tokens is None
    assert token_counts.truncated_totals(sums, [5]).first().tokens == 0
