"""Quality classifier: exact neighbours, direction quality, held-out accuracy, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from loamstream.llm import quality_neighbours as q
from loamstream.llm.queries_neighbours import quality_neighbours

SF = "/root/testdata/sf0.01"
TEXTS = [f"The words of {'text ' * k}follow, as they do. So {k}." for k in range(1, 30)]
JUNK = [f"BUY!! NOW!! {'ONLY!! ' * k}{k}" for k in range(1, 30)]


def _tables(spark):
    docs = [(i, t) for i, t in enumerate([*TEXTS, *JUNK])]
    labels = [(i, int(i < len(TEXTS))) for i, _ in docs if i % 2]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_unlabelled_half_is_told_apart(spark):
    docs, labels = _tables(spark)
    got = {r.doc_id: r.quality_score for r in q.score_quality(docs, labels, near=5).collect()}
    assert all((s > 0.9) == (i < len(TEXTS)) and 0 <= s <= 1 for i, s in got.items()) and len(got) == 58


def test_votes_equal_plain_search():
    rng = np.random.default_rng(1)
    unit = lambda n: (x := rng.standard_normal((n, 8)).astype(np.float32)) / np.linalg.norm(x, axis=1, keepdims=True)
    docs, known, y = unit(40), unit(2 * q.BLOCK * 8 + 77), (rng.random(2 * q.BLOCK * 8 + 77) < 0.7).astype(np.float32)
    got = q.vote(docs, known, y, 9, 4)
    for v, s in zip(docs, got, strict=True):
        sims = sorted(((float(v @ k), t) for k, t in zip(known, y, strict=True)), reverse=True)[:9]
        assert abs(s - sum(c**4 * t for c, t in sims) / sum(c**4 for c, _ in sims)) < 1e-4


def test_directions_span_the_leading_singular_vectors():
    counts = [q.cells(t.encode()) for t in [*TEXTS, *JUNK]]
    df = np.zeros(q.CELLS)
    for c in counts:
        df[list(c)] += 1
    idf = np.where(df > 0, np.log((len(counts) + 1) / (df + 1)), 0.0)
    a = q.weighted(counts, idf)
    exact = np.linalg.svd(a, full_matrices=False)[1][:4]
    assert np.allclose(np.linalg.norm(a @ q.latent(counts, idf, 4), axis=0), exact, rtol=1e-2)


def test_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality_neighbours(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.97 * len(held)


def test_defined_results(spark):
    docs, labels = _tables(spark)
    more = spark.createDataFrame([(None, "BUY!! NOW!!"), (900, None), (901, ""), (902, " \n"), (903, "Long words. " * 50_000), (1, TEXTS[1]), (1, TEXTS[1])], "doc_id long, text string")
    for c in ("id", "TEXT2", "quality", "Quality_Score", "y"):
        docs, more = docs.withColumn(c, F.lit("other")), more.withColumn(c, F.lit("other"))
    odd = labels.union(spark.createDataFrame([(None, 1), (900, None), (1, 0)], "doc_id long, quality int"))
    rows = q.score_quality(docs.union(more), odd).collect()
    got = {(r.doc_id, r.text): r.quality_score for r in rows}
    share = got[901, ""]
    assert 0 < share < 1 and abs(got[900, None] - share) < 1e-5 and abs(got[902, " \n"] - share) < 1e-5
    assert len(rows) == 65 and np.ptp([r.quality_score for r in rows if (r.doc_id, r.text) == (1, TEXTS[1])]) < 1e-5 and {r.quality for r in rows} == {"other"}
    assert 0 <= got[903, "Long words. " * 50_000] <= 1
    assert {r.quality_score for r in q.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert q.score_quality(docs.limit(0), labels).collect() == []
