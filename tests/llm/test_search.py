"""Ranked lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstream.llm import lexical_search
from loamstream.llm.lexical_search import search_documents, tree

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def plain(docs, items, top):
    own = [(i, w) for i, t in docs if (w := words(t))]
    n_all, l_all = len(own), sum(len(w) for _, w in own)
    df = Counter(x for _, w in own for x in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in own:
            tf, m = Counter(w), 75 + 25 * len(w) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=repr)


def _table(seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["É", "é", "Ab", "aB", "x_y"]
    weight = [1 / (k + 1) for k in range(len(pool))]
    docs = [(i, " ".join(rng.choices(pool, weight, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # one text many times
    docs += [(i, t.upper()) for i, t in docs[:20]] + [(None, docs[3][1]), (None, docs[5][1]), (7, None), (8, ""), (9, "-- \n")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(30)] + [(30, docs[5][1]), (31, None), (32, ""), (33, "unknown"), (None, "w3"), (4, "w1 w1 w59")]
    return docs, items


@pytest.mark.parametrize(("block", "leaf", "postings"), [(1 << 22, 16, 1 << 20), (200, 2, 300)])
def test_equals_plain(spark, monkeypatch, block, leaf, postings):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    docs, items = _table(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(0), "SCORE": F.lit(1)})
    got = search_documents(frame, spark.createDataFrame(items, "item_id long, text string"), top=7, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, items, 7)


def test_bounds_cut_most_of_the_tree():
    """An item that quotes a text is answered without scoring most leaves, and rightly."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        t = np.array(sorted(x * 8 + i % 8 for x in rng.sample(range(50), rng.randint(5, 30))))  # eight languages
        rows.append((t, np.array([rng.randint(1, 3) for _ in t]), 75 + 3 * len(t), i))
    root = tree(rows)
    weight = np.zeros(400, np.int64)
    weight[rows[17][0]] = 1000 + 10 * rows[17][0]
    seen = []
    best: list = []
    stack = [root]
    leaves = 0
    while stack:
        node = stack.pop()
        leaves += isinstance(node.kids[0], list)
        stack += [k for k in node.kids if not isinstance(k, list)]
    lexical_search.search(_counting(root, seen), weight, best, 3)
    scores = sorted(((int((weight[t] * (10**9 * tf // (1000 * tf + 12 * m))).sum()), -i) for t, tf, m, i in rows), reverse=True)
    assert sorted(best, reverse=True) == scores[:3] and -best[-1][1] >= 0 and scores[0][1] == -17
    assert leaves > 200 and sum(seen) < leaves / 5


class _Counted(lexical_search.Node):
    __slots__ = ("_gain", "leaf", "seen")

    @property
    def gain(self):
        self.seen.append(self.leaf)
        return self._gain


def _counting(node, seen):
    out = _Counted.__new__(_Counted)
    out.terms, out._gain, out.start, out.least, out.seen = node.terms, node.gain, node.start, node.least, seen
    out.leaf = isinstance(node.kids[0], list)
    out.kids = node.kids if out.leaf else [_counting(k, seen) for k in node.kids]
    return out


def test_long_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "common " * 100_000 + "rare"), (2, "common rare"), (3, "else")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "rare")], "item_id string, text string")
    got = search_documents(docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1, 2), ("a", 2, 1)]
    assert search_documents(docs.limit(0), items).collect() == [] == search_documents(docs, items.limit(0)).collect()
