"""Near copies of the pipeline stage against all pairs, compared one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamstream.llm import jaccard_dedup
from loamstream.llm.jaccard_dedup import common, one_of_each, similar_documents

from . import plain


def _set(t):
    w = plain.words((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def all_pairs(docs):
    """Class of each document by brute force: linked if five-word Jaccard is 0.8 or more."""
    texts = dict(docs)
    sets = {i: _set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += texts[a] != texts[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, links


def _copies(seed):
    """Families of copies with 0 to 6 words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 120, 200, 400]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate([*out, "", None, " \n"]))


def test_classes_equal_all_pairs(spark):
    docs = _copies(5)
    want, links = all_pairs(docs)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert links > 50 and got == want


def test_stage_removes_ordinary_near_copies(spark):
    """Copies that differ in over two fingerprint bits go too."""
    docs = [(i, t) for i, t in _copies(6) if t]
    want, _ = all_pairs(docs)
    rows = [(i, t, "en", "a", len(t)) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    two_bits = {i for i, (_, root) in plain.near(docs).items() if i == root}
    assert kept == {i for i, root in want.items() if i == root} and kept < two_bits


def _edited(rng, base, places):
    w = list(base)
    for at in places:
        w[at] = "".join(rng.choice("ijklmnop") for _ in range(5))
    return " ".join(w)


def _families():
    """A hub with spokes (each near the hub, not near another), and a group whose members are pairwise just under 0.8."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    hub = [" ".join(base)] + [_edited(rng, base, rng.sample(range(5, 395), 8)) for _ in range(120)]
    base = ["".join(rng.choice("qrstuvwx") for _ in range(5)) for _ in range(400)]
    under = [_edited(rng, base, rng.sample(range(5, 395), 6)) for _ in range(120)]
    docs = [*hub, *under]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("slice_", "cells", "family"), [(2048, 1 << 20, 1 << 14), (20, 1 << 20, 1 << 14), (2048, 9000, 30)])
def test_families_equal_all_pairs(spark, monkeypatch, slice_, cells, family):
    for name, value in (("SLICE", slice_), ("CELLS", cells), ("FAMILY", family)):
        monkeypatch.setattr(jaccard_dedup, name, value)
    docs = _families()
    want, links = all_pairs(docs)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and links > 120 and 60 < len(set(want.values())) < 122


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30_000, n)) for n in (0, 5, 9000, 20_000, 1)]
    got = common(sets[:3], sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:3]]


ROWS = [
    (1, "one two three four five six"), (None, "One two three four five six"), (None, "One two three four five six"), (None, "other words"),
    (4, "same row"), (4, "same row"), (4, "another text"), (7, "another text"), (5, None), (6, ""), (2, "word " * 50_000 + "end"), (3, "word " * 60_000 + "end"),
]


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("k", "S", "_s", "root", "n", "text2"):
        docs = docs.withColumn(c, F.lit("other"))
    rows = similar_documents(docs).collect()
    assert len(rows) == len(ROWS)
    got = {(r.doc_id, r.component_id) for r in rows}
    assert got == {(1, 1), (None, 1), (None, None), (4, 4), (7, 4), (5, 5), (6, 5), (2, 2), (3, 2)}
    left = one_of_each(docs)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [ROWS[0], ROWS[3], (4, "same row"), (4, "another text"), (5, None), ROWS[10]], key=repr)
    assert left.columns == ["doc_id", "text", "k", "S", "root", "n", "text2"]
    assert similar_documents(docs.limit(0)).collect() == [] == one_of_each(docs.limit(0)).collect()


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """With bands that no two texts share, copies within two bits of the SimHash still meet, and only similar ones go."""
    from loamstream.llm.simhash import fingerprint_of, shingles

    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    text = " ".join(base)
    bits = lambda t: int(fingerprint_of([shingles(t.encode(), 5)])[0])
    near = next(t for t in (_edited(rng, base, [599]) for _ in range(200)) if (bits(t) ^ bits(text)).bit_count() <= 2)
    docs = [(1, text), (2, near), (3, " ".join(base[::-1])), (4, ""), (5, near)]
    rows = [(i, t, "en", "a", len(t)) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    banded = jaccard_dedup._banded
    monkeypatch.setattr(jaccard_dedup, "_banded", lambda d: banded(d).withColumn("bands", F.array(F.xxhash64("s"))))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert kept == {1, 3, 4}


@pytest.mark.parametrize(("make", "family"), [(lambda: _copies(7), 1 << 14), (lambda: _copies(7), 6), (_families, 30)])
def test_stage_holds_all_of_a_fingerprint_class(spark, monkeypatch, make, family):
    """Texts of one fingerprint, ruled by a repeated shingle, are one class; near copies in it meet though its first text is like none."""
    from loamstream.llm.simhash import fingerprint_of, shingles

    docs = [(i, "ha " * 2000 + t) for i, t in make() if t]
    assert len({int(fingerprint_of([shingles(t.encode(), 5)])[0]) for _, t in docs}) == 1
    docs += [(2000, ""), (2001, " \n"), (2002, "\t")]
    want, links = all_pairs(docs)
    # bands that no two texts share: what meets now meets by the class alone
    banded = jaccard_dedup._banded
    monkeypatch.setattr(jaccard_dedup, "_banded", lambda d: banded(d).withColumn("bands", F.array(F.xxhash64("s"))))
    monkeypatch.setattr(jaccard_dedup, "FAMILY", family)
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert links > 50 and kept == {i for i, root in want.items() if i == root}


def test_cut_classes_share_a_bucket(spark):
    """Two similar texts of a class share a bucket; texts that share only a few common shingles meet in none."""
    rng = random.Random(3)
    sets = [[]] * 4 + [[1, 2, 3, 10 + 100 * i, *range(1000 * i, 1000 * i + 40)] for i in range(1, 301)]
    sets += [sorted(set(x) - set(rng.sample(x, 4))) for x in sets[4:82]]
    rows = spark.createDataFrame([(i % 2, i, len(x), i) for i, x in enumerate(sets)], "h long, k long, n int, root long")
    held = spark.createDataFrame(list(enumerate(sets)), "k long, x array<long>")
    met = {}
    for r in jaccard_dedup._cut(rows, held).collect():
        met.setdefault(r.h, set()).add(r.k)
    pairs = {(a, b) for x in met.values() for a in x for b in x if a < b}
    want = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b])
            if a % 2 == b % 2 and 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))}
    assert len(want) > 30 and want <= pairs and len(pairs) < 2 * len(want)
