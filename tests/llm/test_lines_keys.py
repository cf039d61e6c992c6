"""Line dedup where rows share an id: null ids, and one id with different texts."""

from loamstream.llm.line_dedup import dedup_lines

RUN = "one two\nthree four\nfive six"
LONGER = "\n".join(f"line {i}" for i in range(12)) + "\n" + RUN


def _clean(spark, docs):
    df = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted((r.doc_id or -1, r.text, r.line_dedup.clean_text, r.line_dedup.n_removed) for r in df.collect())


def test_null_ids_do_not_share_deletions(spark):
    """The second null-id text repeats the run at line 12; the third is shorter than that and repeats nothing."""
    docs = [(1, RUN), (None, LONGER), (None, "a\nb\nc\nd"), (None, "\n".join("xyzuvwrstopqnm"))]
    got = _clean(spark, docs)
    assert {(t, n) for _, t, _, n in got} == {(RUN, 0), (LONGER, 3), (docs[2][1], 0), (docs[3][1], 0)}


def test_one_id_with_two_texts(spark):
    other = "p\nq\nr\ns\nt\nu\nv"
    got = _clean(spark, [(1, RUN), (2, "x\n" + RUN), (2, other)])
    assert got == sorted([(1, RUN, RUN, 0), (2, "x\n" + RUN, "x", 3), (2, other, other, 0)])


def test_a_run_in_two_texts_of_one_id_stays_once(spark):
    got = _clean(spark, [(None, RUN), (None, RUN + "\nmore"), (None, RUN + "\nmore")])
    assert sorted({n for _, t, _, n in got}) == [0, 3] and sum(n == 0 for *_, n in got) in (1, 2)
