"""Line dedup of long passages in one or two lines."""

import random

import corpus_pipeline
from loamstream.llm.line_dedup import dedup_lines

from . import plain


def passages(docs, w, least):
    """(id, text) with later runs of w lines, or of fewer lines and at least so many words, deleted."""
    first, split = {}, {}

    def runs(rows, full):
        c = [len(plain.words(rows[n])) for n in full]
        for s in range(len(full)):
            for n in range(1, w + 1):
                if s + n <= len(full) and (n == w or sum(c[s : s + n]) >= least):
                    yield s, n, tuple(rows[k] for k in full[s : s + n])

    for i, t in sorted(docs):
        rows = t.split("\n")
        split[i] = rows, [n for n, x in enumerate(rows) if plain.words(x)]
        for s, _, key in runs(*split[i]):
            first.setdefault(key, (i, s))
    out = []
    for i, (rows, full) in split.items():
        gone = {k for s, n, key in runs(rows, full) if first[key] != (i, s) for k in full[s : s + n]}
        out.append((i, "\n".join(x for n, x in enumerate(rows) if n not in gone), len(full), len(gone)))
    return sorted(out)


def test_passages_equal_plain(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 5, 6, 9]))) for _ in range(25)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 7)))) for i in range(90)]
    df = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), words=10)
    got = sorted((r.doc_id, r.line_dedup.clean_text, r.line_dedup.n_lines, r.line_dedup.n_removed) for r in df.collect())
    assert got == passages(docs, 3, 10) != plain.lines(docs, 3)


def test_stage_cuts_a_long_line_and_two_half_lines(spark):
    line = " ".join(f"w{i}" for i in range(50))
    a, b = " ".join(f"a{i}" for i in range(25)), " ".join(f"b{i}" for i in range(25))
    texts = {1: line, 2: "own words\n" + line, 3: f"first\n{a}\n{b}", 4: f"{a}\n{b}\nlast", 5: a + "\nelse"}
    rows = [(i, t, "en", "a", len(t)) for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert got == {1: line, 2: "own words", 3: texts[3], 4: "last", 5: texts[5]}
