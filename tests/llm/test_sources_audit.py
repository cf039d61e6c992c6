"""Source divergence audit against a plain version on whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstream.llm.source_audit import audit_sources, merge


def plain(docs, least, top):
    word = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = {c: c + 32 for c in range(65, 91)}
    rows = [(l or "", s or "", word.findall((t or "").translate(upper))) for t, l, s in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        count = defaultdict(Counter)
        for _, s, w in own:
            count[s].update(t for t in w if df[t] >= least)
        sources = {r[1] for r in own}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in sources:
            pairs = [(o, sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept)) for o in sources if o != s]
            terms = [(t, (p(count[s], t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(order, 1)}
    return out


def _docs(seed, n=150):
    rng = random.Random(seed)
    pool = ["The", "the", "été", "ÉTÉ", "x1y", "a_b", "naïve", "\U00010400w", "ß", "Zoo"] + ["".join(rng.choice("abc") for _ in range(3)) for _ in range(20)]
    docs = [(rng.choice([" ", "\n", "-"]).join(rng.choices(pool, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"])) for _ in range(n)]
    return [*docs, (None, "en", "empty"), ("", "xx", "alone"), ("12 34", "yy", "a"), ("-", "yy", "b"), *[("same words here", "en", "s1")] * 3]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_equals_plain(spark, block):
    docs = _docs(1)
    frame = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("x"), "ID": F.lit(2)})
    got = audit_sources(frame, top=5, block=block).collect()
    assert len(got) == len(set(got))
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == plain(docs, 3, 5)


def test_languages_without_kept_terms(spark):
    docs = [("a b", "en", "x"), ("c", "en", "y"), (None, "de", None)]
    got = audit_sources(spark.createDataFrame(docs, "text string, lang string, source string")).collect()
    assert sorted(tuple(r) for r in got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_long_text_and_empty_table(spark):
    schema = "text string, lang string, source string"
    docs = [("word " * 200_000, "en", "a"), ("word other", "en", "b"), ("word other", "en", "b"), ("other", "en", "c")]
    got = audit_sources(spark.createDataFrame(docs, schema)).collect()
    assert {tuple(r) for r in got} == plain(docs, 3, 200)
    assert audit_sources(spark.createDataFrame([], schema)).collect() == []


def test_merge_is_exact_beyond_doubles():
    rng = np.random.default_rng(3)
    ids = [np.sort(rng.choice(40, k, replace=False)) for k in (9, 30)]
    counts = [rng.integers(1, 10**12, len(i)) for i in ids]
    totals = [int(c.sum()) + 40 for c in counts]

    def p(side, t):
        at = dict(zip(ids[side].tolist(), counts[side].tolist(), strict=True))
        return 1 + 10**9 * (at.get(t, 0) + 1) // totals[side]

    both = set(ids[0].tolist()) | set(ids[1].tolist())
    want = [sum((p(x, t) - p(y, t)) ** 2 // p(y, t) for t in both) for x, y in ((0, 1), (1, 0))]
    assert merge((ids[0], counts[0]), (ids[1], counts[1]), *totals) == (*want, len(both))
    assert merge((ids[1], counts[1]), (ids[0], counts[0]), *totals[::-1]) == (*want[::-1], len(both))
