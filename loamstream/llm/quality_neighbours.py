"""Quality classifier: a document's labelled nearest neighbours in latent-semantic space vote.

1. Terms say how a text is written, not what about: the shape of each word (upper case, lower case,
   digits, signs; runs shortened), adjacent shapes, and whether a word repeats the one before. They are
   hashed to `CELLS` cells. One pass counts in how many documents of the whole corpus each cell occurs.
2. Labelled documents, a hash-drawn sample of about `SAMPLE`, are weighted by count and inverse document
   frequency, scaled to length 1, and a randomised singular value decomposition of this matrix
   gives the `DIMS` latent directions. The driver holds the sample's cell counts for that, nothing else.
3. Directions and the sample's vectors, at most some MB by these two bounds, are broadcast. Tasks fold
   each document in, multiply blocks of documents by blocks of labelled vectors (all of them: the
   cosines are exact), and the `NEAR` most similar vote with weight cosine ** `POWER`.

Documents are not shuffled; each is scored whole in the task that holds it. An id is labelled 0 if one of
its labels is; of several texts with one labelled id the smallest is learned from, so that repeated rows do not swell the sample.

Defined results: null and empty texts, and texts whose terms occur in no or in all documents, have no
direction and score the share of label 1 in the sample; without labels every score is 0.5; null labels
and ids teach nothing; repeated rows score alike up to the last of
`DIGITS` digits (single-precision products); an empty table gives an empty result. Extra columns
pass through; `quality_score` is replaced where it exists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import chunks, texts
from .shared import cols, others

RESULT = "quality_score"
CELLS = 1 << 14
DIMS = 64
SAMPLE = 8192
NEAR = 30
POWER = 8
BLOCK = 512
SHAPE = 8
DIGITS = 6
_KINDS = bytes(85 if 65 <= c <= 90 else 108 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class Remembered(dict):
    """key -> fn(key), emptied when it holds too many."""

    LIMIT = 200_000

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[key] = self.fn(key)
        return v


def _cell(kind: bytes, term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + term) % CELLS


_shape = Remembered(lambda w: _RUN.sub(rb"\1", w.translate(_KINDS))[:SHAPE])
_single = Remembered(lambda s: _cell(b"1", s))
_double = Remembered(lambda s: _cell(b"2", s[0] + b" " + s[1]))
_SAME, _OTHER = _cell(b"3", b"same"), _cell(b"3", b"other")


def cells(text: bytes) -> Counter:
    """Counts of a text's term cells."""
    words = text.split()
    shapes = list(map(_shape.__getitem__, words))
    out = Counter(map(_single.__getitem__, shapes))
    out.update(map(_double.__getitem__, zip(shapes, shapes[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    for cell, n in ((_SAME, same), (_OTHER, len(words) - 1 - same)):
        if n > 0:
            out[cell] += n
    return out


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each cell; each task sends its cells once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1, np.int64)
        for part in chunks(batches, "text", 4 << 20):
            for t in texts(part, "text"):
                total[list(cells(t))] += 1
            total[CELLS] += part.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS + 1 at most
    out = np.zeros(CELLS + 1)
    for r in rows:
        out[r.cell] = r.n
    return int(out[CELLS]), out[:CELLS]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[Counter], np.ndarray]:
    """Cell counts and labels of the sample, in order of id."""
    known = labels.dropna().groupBy("id").agg(F.min("y").alias("y"))
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(known.count(), 1))))
    rows = docs.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            held = [cells(t) for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("y"), pa.array([list(c) for c in held], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c in held], pa.list_(pa.int64()))], names=["id", "y", "cells", "counts"])

    found = rows.select("id", F.col("y").cast("long").alias("y"), "text").mapInArrow(run, "id long, y long, cells array<int>, counts array<long>")
    held = sorted(found.collect(), key=lambda r: r.id)  # about `sample` rows
    return [Counter(dict(zip(r.cells, r["counts"], strict=True))) for r in held], np.array([r.y != 0 for r in held], np.float32)


def weighted(counts: list[Counter], idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0) over all cells."""
    out = np.zeros((len(counts), len(idf)), np.float32)
    for row, c in zip(out, counts, strict=True):
        if c:
            at = list(c)
            row[at] = np.array(list(c.values())) * idf[at]
            row /= np.linalg.norm(row) or 1.0
    return out


def latent(counts: list[Counter], idf: np.ndarray, dims: int) -> np.ndarray:
    """(cells, dims): leading right singular vectors of the weighted rows, by a randomised range finder."""
    rng = np.random.default_rng(13)
    size = min(dims + 10, len(counts))
    blocks = [slice(i, i + BLOCK) for i in range(0, len(counts), BLOCK)]
    basis = rng.standard_normal((len(idf), size)).astype(np.float32)
    for _ in range(3):
        image = np.zeros_like(basis)
        for b in blocks:
            a = weighted(counts[b], idf)
            image += a.T @ (a @ basis)
        basis = np.linalg.qr(image)[0]
    small = np.zeros((size, size))
    for b in blocks:
        y = weighted(counts[b], idf) @ basis
        small += y.T @ y
    values, turn = np.linalg.eigh(small)
    lead = [k for k in np.argsort(-values)[:dims] if values[k] > 1e-9]
    return (basis @ turn[:, lead]).astype(np.float32)


def placed(counts: list[Counter], idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1, or 0 for texts without a direction."""
    out = weighted(counts, idf) @ directions
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, y: np.ndarray, near: int, power: int) -> np.ndarray:
    """Share of label 1 among the `near` most similar labelled vectors, each weighing cosine ** power."""
    near = min(near, len(known))
    sims = np.empty((len(vectors), 0), np.float32)
    tags = np.empty((len(vectors), 0), np.float32)
    for i in range(0, len(known), BLOCK * 8):
        block = vectors @ known[i : i + BLOCK * 8].T
        k = min(near, block.shape[1])
        at = np.argpartition(-block, k - 1, axis=1)[:, :k]
        sims = np.concatenate([sims, np.take_along_axis(block, at, 1)], axis=1)
        tags = np.concatenate([tags, y[i : i + BLOCK * 8][at]], axis=1)
    at = np.argsort(-sims, axis=1, kind="stable")[:, :near]
    weight = np.clip(np.take_along_axis(sims, at, 1).astype(np.float64), 0, 1) ** power
    tags = np.take_along_axis(tags, at, 1)
    return ((weight * tags).sum(1) + 1e-9 * y.mean(dtype=np.float64)) / (weight.sum(1) + 1e-9)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
                  sample: int = SAMPLE, dims: int = DIMS, near: int = NEAR, power: int = POWER) -> DataFrame:
    """Every document with `quality_score`, 0 to 1. `labels` are the rows that may be learned from."""
    docs = docs.select(*cols(others(docs, RESULT)))
    plain = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counts, y = labelled(plain, labels.select(F.col(id).cast("long").alias("id"), F.col(label).alias("y")), sample)
    if not counts:
        return docs.withColumn(RESULT, F.lit(0.5))
    n, df = document_frequencies(plain)
    idf = np.where(df > 0, np.log((n + 1) / (df + 1)), 0.0)
    directions = latent(counts, idf, dims)
    known = np.concatenate([placed(counts[i : i + BLOCK], idf, directions) for i in range(0, len(counts), BLOCK)])
    sent = docs.sparkSession.sparkContext.broadcast((idf, directions, known, y))
    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, directions, known, y = sent.value
        for part in chunks(batches, text, 4 << 20):
            raw = texts(part, text)
            scores = [vote(placed([cells(t) for t in raw[i : i + BLOCK]], idf, directions), known, y, near, power) for i in range(0, len(raw), BLOCK)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores).round(DIGITS))], names=[*part.schema.names, RESULT])

    return docs.mapInArrow(run, schema)
