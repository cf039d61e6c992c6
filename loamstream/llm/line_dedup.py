"""Line dedup: winnowed fingerprints over line hashes, joined and extended to repeated runs.

Lines without a word are passed over. Of every WINDOW consecutive lines the smallest hash (the last of
equals) is selected; two equal runs of WINDOW lines select the same line, so every repeated run of
that length shares a fingerprint: that is the guarantee. Positions are joined by fingerprint; those
of a fingerprint met twice or more are extended both ways to all runs of WINDOW lines around them,
each run is placed against its earliest place, and what comes later is deleted, overlaps merged.

With `words` given, a run of fewer lines counts too if it has that many words: each such window of 1 to
WINDOW - 1 lines is a position of its own, so a long passage is found however few lines it fills.

Hashes leave the tasks, never lines: one row per selected position (two in WINDOW + 1 lines). Counts
and earliest places are combined before each shuffle, and joins carry one row per position, so a line
of a third of all documents costs rows in proportion to its occurrences. The text is shuffled once, to
meet its own deletions.

Defined results: a null or empty text has no lines; texts of fewer than WINDOW lines keep all but long passages; order
is (id, text hash, line), a null id comes last; rows of one id and one text count as one place and lose
the same lines, rows of one id and different texts are different documents; an empty table gives an empty result. Extra columns pass through; one named like the result column
is replaced, and the working names _id, _s and _starts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import append_struct, chunks, texts
from .shared import cols, others, text_hash

WINDOW = 3
PASSAGE = 50
LAST = 2**63 - 1
RESULT = "line_dedup"
FIELDS = T.StructType([
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_runs", T.LongType()),
    T.StructField("clean_text", T.StringType()),
])
_ARROW = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("clean_text", pa.string())])


def lines_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places of those that have a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(b" \t\r\x0b\x0c")]


def winnow(h: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected places, the first window each stands for, and how many windows in a row it stands for."""
    n = len(h) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    start = np.flatnonzero(doc[:n] == doc[w - 1 :])
    low, at = h[start], start.copy()
    for j in range(1, w):
        nxt = h[start + j]
        take = nxt <= low
        low, at = np.where(take, nxt, low), np.where(take, start + j, at)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[new], start[new], np.diff(np.append(new, len(at)))


def long_windows(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int, words: int) -> np.ndarray:
    """Where n lines of one document have at least so many words together."""
    m = max(0, len(h) - n + 1)
    total = sum((count[j : m + j] for j in range(n)), np.zeros(m, np.int64))
    return np.flatnonzero((doc[:m] == doc[n - 1 :][:m]) & (total >= words))


def selected(docs: DataFrame, w: int, words: int | None) -> DataFrame:
    """(f, id, s, first, n, around): fingerprint, document, first window's line number, lines of a window, hashes of all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            hashes, owner, number, count, again = [], [], [], [], []
            for d, t in enumerate(texts(part, "t")):
                lines, full = lines_of(t)
                hashes += [xxhash.xxh3_64_intdigest(lines[i]) for i in full]
                owner += [d] * len(full)
                number += range(len(full))
                if words is not None:
                    count += (c := [len(lines[i].split()) for i in full])
                    # one line alone is told by 128 bits
                    again += [xxhash.xxh3_64_intdigest(lines[i], 1) if k >= words else 0 for i, k in zip(full, c, strict=True)]
            h = np.array(hashes, np.uint64).view(np.int64)
            doc, number = np.array(owner, np.int64), np.array(number, np.int64)
            at, first, runs = winnow(h, doc, w)
            size = runs + w - 1
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            yield rows(part, h[at], doc[at], number[first], w, size, h[place])
            if words is not None:
                many, second = np.array(count, np.int64), np.array(again, np.uint64).view(np.int64)
                for n in range(1, w):
                    at = long_windows(h, doc, many, n, words)
                    run_of = np.stack([h[at], second[at]] if n == 1 else [h[at + j] for j in range(n)], axis=1)
                    f = h[at]
                    for j in range(1, n):
                        f = f * np.int64(0x1E3779B97F4A7C15) ^ h[at + j]
                    yield rows(part, f, doc[at], number[at], n, np.full(len(at), run_of.shape[1]), run_of.reshape(-1))

    def rows(part: pa.RecordBatch, f, doc, first, n, size, around) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        whose = pa.array(doc)
        return pa.RecordBatch.from_arrays([
            pa.array(f), part.column("id").take(whose), part.column("s").take(whose), pa.array(first),
            pa.array(np.full(len(f), n, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(around))],
            names=["f", "id", "s", "first", "n", "around"])

    return docs.mapInArrow(run, "f long, id long, s binary, first long, n int, around array<long>")


def later_runs(docs: DataFrame, w: int = WINDOW, words: int | None = None) -> DataFrame:
    """(id, s, starts): the runs of each document that also start at an earlier place, as (start, n lines)."""
    seeds = selected(docs, w, words)
    met = seeds.groupBy("f").count().filter("count > 1").select("f")
    runs = seeds.join(met, "f", "left_semi").select(
        "id", "s", "first", "n", F.posexplode(F.when(F.col("n") == w, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("around") - (w - 1), F.lit(1))), lambda i: F.slice("around", i, F.lit(w)))
        ).otherwise(F.array("around"))).alias("j", "run"),
    ).select("run", F.struct("id", "s", (F.col("first") + F.col("j")).alias("start"), "n").alias("place"))
    first = runs.groupBy("run").agg(F.min("place").alias("earliest"), F.max("place").alias("last")).filter("last > earliest")
    late = runs.join(first.select("run", "earliest"), "run").filter(F.col("place") > F.col("earliest"))
    return late.groupBy("place.id", "place.s").agg(F.collect_set(F.struct("place.start", "place.n")).alias("starts"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", w: int = WINDOW, words: int | None = None) -> DataFrame:
    """Every document with a `line_dedup` struct: n_lines, n_removed, n_runs, clean_text.

    What repeats is a run of w lines, or with `words` also one of fewer lines and at least so many words.
    """
    keep = cols(others(docs, RESULT, "_id", "_s", "_starts"))
    key = F.coalesce(F.col(id).cast("long"), F.lit(LAST))
    late = later_runs(docs.select(key.alias("id"), text_hash(text).alias("s"), F.col(text).alias("t")), w, words)
    told = docs.select(*keep, key.alias("_id"), text_hash(text).alias("_s")).join(
        late.select(F.col("id").alias("_id"), F.col("s").alias("_s"), F.col("starts").alias("_starts")), ["_id", "_s"], "left").drop("_id", "_s")

    def delete(batch: pa.RecordBatch) -> pa.Array:
        rows = []
        for t, starts in zip(texts(batch, text), batch.column("_starts").to_pylist(), strict=True):
            lines, full = lines_of(t)
            gone = np.zeros(len(full) + 1, np.int64)
            if starts:
                at, n = np.array([(x["start"], x["n"]) for x in starts]).T
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n, -1)
            gone = np.cumsum(gone)[:-1] > 0
            if gone.any():
                drop = {full[i] for i in np.flatnonzero(gone).tolist()}
                t = b"\n".join([x for i, x in enumerate(lines) if i not in drop])
            rows.append({"n_lines": len(full), "n_removed": int(gone.sum()),
                         "n_runs": int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)),
                         "clean_text": t.decode("utf-8", "replace")})
        return pa.array(rows, _ARROW)

    return append_struct(told, RESULT, FIELDS, delete, text).drop("_starts")
