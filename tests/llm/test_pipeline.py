"""The pipeline against its plain version, stage by stage, on the smallest documents."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from loamstream.llm.mixing import mix
from loamstream.llm.queries_quality import SQL

from . import plain
from .test_jaccard import all_pairs
from .test_lines_words import passages

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({SQL}) WHERE kept").fetchall()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {i: t for i, t, n, gone in passages([(i, docs[i].text) for i in kept], 3, 50) if n == 0 or gone < n}
    texts = {i: texts[i] for i, root in all_pairs(list(texts.items()))[0].items() if i == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: clean for i, n, hit, _, clean in plain.contamination(list(texts.items()), items) if hit == 0 or hit < n}
    frame = spark.createDataFrame([(i, t, docs[i].lang, docs[i].source) for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    want = {r.doc_id: (r.text, r.copies) for r in mix(frame).filter("copies > 0").collect()}
    got = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(docs.columns) < set(out.columns) and out.filter(F.col("copies") < 1).isEmpty()


ROWS = [
    (1, "word " * 3 + "of a kept text that is long enough to stay here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0),
    (None, "some words of another kept text that is long enough to stay", "de", None, 3), (3, "long " * 20_000, "en", "b", 9),
    (4, "same row with words enough for the rules to let it stay", "en", "b", 5), (4, "same row with words enough for the rules to let it stay", "en", "b", 5),
]


def test_stages_handle_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit("x"), "line_dedup": F.lit("x"), "_s": F.lit(1)})
        sizes = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
            sizes.append(out.count())
        assert max(sizes) <= len(rows)
        if rows:
            near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
            assert sorted(r.doc_id or 0 for r in near) == [0, 1, 2, 3, 4]  # null and empty texts are one class: id 2 stays
