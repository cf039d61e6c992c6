"""Toxicity: noisy-channel decoding of disguised words, then a lexicon learned from labels.

1. Character trigrams of the whole corpus (fixed alphabet, so the table has 64^3 cells at any size)
   give the source model.
2. A word that mixes letters with look-alike signs, stretches letters, or is spaced out becomes a
   character lattice: each sign may stand for letters, be noise, or stay; a stretched letter may be
   one or two. Viterbi finds the likeliest word under the source model and the channel's costs, exactly
   and at any length: the state is the last two letters, nothing is pruned.
3. Words and their beginnings and ends are counted in labelled documents, restored words in place of
   disguised ones. A shrunk share of toxic documents is a feature's weight, a word weighs as its best
   feature, a document as its heaviest word. All labelled documents of a fourth fold set the weight at
   which a document counts as toxic; scores are stretched so that this is 0.5.

What is learned from is bounded by `SAMPLE` documents (a hash decides, the fraction follows from a
count), so the lexicon sent to the tasks is bounded too. Counting and scoring cover all documents,
each read whole in the task that holds it; no text is shuffled.

Defined results: a null or empty text scores like a text without any known word; a null label is no
label; a document labelled twice is toxic if one label says so; repeated rows score alike; without toxic labels every score is 0; an empty table gives an
empty result. Extra columns pass through; `toxicity` is replaced when it exists, and the working name _s is left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import chunks
from .shared import cols, others

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿ"
EDGE, OTHER, SIZE = 0, 63, 64
CODE = {c: i for i, c in enumerate(LETTERS, 1)}
# What signs may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
LOOK_COST, NOISE_COST, LOST_COST, STAY_COST = math.log(0.5), math.log(0.05), math.log(0.002), math.log(0.02)
ONE_COST, TWO_COST = math.log(0.6), math.log(0.3)
SAMPLE = 20_000
SHRINK = 10.0
KNOWN = 0.3
AFFIXES = (3, 4, 5, 6)
_TRIM = " \t\r\n.,;:?\"'`“”«»„¿…[]{}<>#&%*~^=/\\_-"
_ONE = r"(?:[^\W_]|[@$!|+(€£¡])"
_SPACED = re.compile(rf"(?<!\S)(?:{_ONE}[\s.\-_*]{{1,2}}){{2,}}{_ONE}(?!\S)")
_STRETCH = re.compile(r"(.)\1\1")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_ENDS = re.compile(r"^([!|+$@(])\1+|([!|+$@(])\2+$")


# --- source model ---------------------------------------------------------------------------------
_CODES = np.zeros(0x250, np.int64)
for _c, _i in CODE.items():
    _CODES[ord(_c)] = _i


def codes(text: str) -> np.ndarray:
    """Alphabet numbers of a text: 0 for what is no letter, one class for letters beyond the alphabet."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], OTHER)


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all character trigrams of the corpus; each task sends its non-zero cells once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for part in chunks(batches, "t", 4 << 20):
            c = codes("\n\n" + "\n\n".join(t or "" for t in part.column("t").to_pylist()) + "\n\n")
            total += np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3)
    for r in rows.collect():  # at most 64^3 cells
        out[r.cell] = r.n
    return out


def source_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams interpolated with bigrams and single letters."""
    three = counts.reshape(SIZE, SIZE, SIZE) + 0.0
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
    p3 = (three + 4 * p2) / (three.sum(2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32)


# --- the channel ----------------------------------------------------------------------------------
def disguised(word: str) -> bool:
    if not any(c.isalpha() for c in word):
        return False
    return any(c in LOOKS or not c.isalnum() for c in word) or bool(_STRETCH.search(word))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per sign or stretched letter: what it may stand for, with its cost. '' is noise."""
    out, i = [], 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, ONE_COST), (c * 2, TWO_COST)])
        else:
            may = [(x, LOOK_COST) for x in LOOKS.get(c, "")] + [("", LOST_COST if c.isdigit() else NOISE_COST)]
            may += [(x * 2, LOOK_COST + TWO_COST) for x in LOOKS.get(c, "") if n > 1]
            out.append(may + ([(c * n, STAY_COST * n)] if c.isdigit() else []))
        i = j
    return out


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest restored word: Viterbi over the last two letters, with a step back kept per place and state."""
    states: dict[tuple[int, int], float] = {(EDGE, EDGE): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for options in lattice(word):
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), cost in states.items():
            for piece, price in options:
                x, y, total = a, b, cost + price
                for c in piece:
                    z = CODE.get(c, OTHER if c.isalpha() else EDGE)
                    total += float(model[x, y, z])
                    x, y = y, z
                if total > after.get((x, y), -math.inf):
                    after[x, y], came[x, y] = total, ((a, b), piece)
        states = after
        steps.append(came)
    at = max(states, key=lambda s: states[s] + float(model[s[0], s[1], EDGE]))
    out = []
    for came in reversed(steps):
        at, piece = came[at]
        out.append(piece)
    return "".join(reversed(out))


def restored(token: str, model: np.ndarray) -> str:
    word = _ENDS.sub("", token.strip(_TRIM)).rstrip("!)|")
    if _PLAIN.match(word) and not _STRETCH.search(word):
        return word
    return decode(word, model) if disguised(word) else word


def tokens(text: str) -> set[str]:
    """Distinct words of the lower-cased text; spaced-out words are closed up first."""
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        out.add(re.sub(r"[\s.\-_*]+", "", m[0]))
    return out


def features(word: str) -> list[str]:
    out = ["=" + word]
    for n in AFFIXES:
        if len(word) > n:
            out += ["^" + word[:n], "$" + word[-n:]]
    return out


class Words(dict):
    """token -> value made by `fn`, remembered; emptied when it holds too many."""

    LIMIT = 200_000

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, token: str):
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[token] = self.fn(token)
        return v


# --- learning -------------------------------------------------------------------------------------
def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int) -> DataFrame:
    """(t, y, fold): a bounded sample of folds 0 to 2, and every labelled document of fold 3."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    h = F.xxhash64(F.col("id"), F.lit(5))
    fold = F.pmod(F.shiftright(h, 24), F.lit(4))
    known = known.withColumn("fold", fold).filter((F.col("fold") == 3) | (F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))))
    return docs.select(F.col(id).alias("id"), F.col(text).alias("t")).join(known, "id").select("t", "y", "fold")


def feature_counts(rows: DataFrame, model) -> DataFrame:
    """(feature, toxic, clean) documents; each task adds up what it saw before it sends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value
        seen = Words(lambda tok: features(w) if (w := restored(tok, lm)) else [])
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush():
            yield pa.RecordBatch.from_arrays([
                pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                pa.array([c[0] for c in counts.values()], pa.int64())], names=["feature", "toxic", "clean"])
            counts.clear()

        for part in chunks(batches, "t", 4 << 20):
            for t, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist(), strict=True):
                for f in {f for tok in tokens(t or "") for f in seen[tok]}:
                    counts[f][1 if y else 0] += 1
                if len(counts) > 500_000:
                    yield from flush()
        yield from flush()

    return rows.select("t", "y").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(docs: DataFrame, text: str, sent) -> DataFrame:
    """All columns and `_s`: the weight of each document's heaviest word."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, lexicon = sent.value
        get = lexicon.get
        seen = Words(lambda tok: max((get(f, 0.0) for f in features(restored(tok, lm))), default=0.0))
        for part in chunks(batches, text, 4 << 20):
            s = [max(map(seen.__getitem__, tokens(t or "")), default=0.0) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "_s"])

    return docs.mapInArrow(run, schema)


def threshold(scored: DataFrame, bins: int = 1000) -> float:
    """The weight that splits the second part of the sample with the fewest errors."""
    rows = scored.groupBy(F.floor(F.col("_s") * bins).alias("b")).agg(
        F.sum(F.col("y").cast("long")).alias("bad"), F.count("*").alias("n")).collect()
    wrong = sum(r.bad for r in rows)
    best, cut = wrong, 1.0
    for r in sorted(rows, key=lambda r: -r.b):  # calling everything from this bin up toxic
        wrong += r.n - 2 * r.bad
        if wrong < best and r.b > 0:
            best, cut = wrong, r.b / bins
    lower = [r.b / bins for r in rows if r.b / bins < cut]
    return (cut + max(lower, default=0.0)) / 2 if best < sum(r.bad for r in rows) else 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                   sample: int = SAMPLE) -> DataFrame:
    """Every document with `toxicity`, 0 to 1. `labels` are the rows that may be learned from."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(*cols(others(docs, "toxicity", "_s")))
    lm = source_model(trigram_counts(docs, text))
    rows = labelled(docs, labels, id, text, label, sample)
    counts = feature_counts(rows.filter("fold < 3"), sc.broadcast(lm))
    share = (F.col("toxic") + 1) / (F.col("toxic") + F.col("clean") + SHRINK)
    lexicon = {r.feature: r.p for r in counts.select("feature", share.alias("p")).filter(
        (F.col("p") >= KNOWN) & (F.col("toxic") > 2)).toLocalIterator()}
    sent = sc.broadcast((lm, lexicon))
    cut = threshold(_weights(rows.filter("fold = 3"), "t", sent))
    return _weights(docs, text, sent).withColumn("toxicity", _stretched(F.col("_s"), cut)).drop("_s")


def _stretched(s: Column, cut: float) -> Column:
    if cut >= 1.0:
        return s * 0.0
    return F.when(s < cut, 0.5 * s / cut).otherwise(0.5 + 0.5 * (s - cut) / (1 - cut))
