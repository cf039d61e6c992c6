"""Benchmark decontamination: an FM-index per training shard, searched for every benchmark phrase.

A shard is a bounded slice of a partition (`SHARD_BYTES` of text). Its words are mapped to the
benchmark's vocabulary; words outside it cannot be part of a match, so only runs of vocabulary words
at least as long as the shortest phrase are indexed. All phrases are searched backwards at once
through wavelet ranks, occurrences are located by sampled suffix positions and merged to spans.

The benchmark is the stated query set. Its size is measured first. One of at most `BLOCK_BYTES` is sent
whole, and the corpus is read once and never shuffled. A larger one is searched in blocks, one after
the other: a block is sent, what it hits is written to the shared folder as rows of texts (by hash)
that hold a phrase, and the block is taken back; at the end the hits of all blocks meet the documents.
So neither the driver nor a task holds more than one block, whatever the benchmark.

Defined results: a null or empty text has no words and no hit; an item without words has no phrase;
an item whose id is null still marks words but is not listed; rows with the same id count as one
item; repeated documents are judged each on its own; an empty benchmark marks nothing. Extra columns
pass through; a column that is named like the result is replaced, and the working names _k, _hits and
_items are left out where there are several blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import append_struct, chunks, texts
from .fm_index import FmIndex
from .shared import cols, others, settle_table, text_hash

PHRASE = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
RESULT = "contamination"
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("clean_text", T.StringType()),
])

# bytes of words: digits, letters (lower-cased), and every byte of a character beyond ASCII
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(text: bytes) -> bytes:
    """Lower-cased A-Z; everything that is no word character becomes a blank of the same length."""
    return text.translate(_FOLD)


class Phrases:
    """Phrases of one benchmark block: distinct windows by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], k: int = PHRASE):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = fold(text).split()
            n = min(k, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                owners.setdefault(tuple(words[i : i + n]), set()).update([item] if item is not None else [])
        self.ids = {w: i for i, w in enumerate(sorted({w for p in owners for w in p}), 2)}
        self.symbols = len(self.ids) + 2  # 0 ends the sequence, 1 separates runs
        self.shortest = min(map(len, owners), default=0)
        self.by_length = []
        for n in sorted(set(map(len, owners))):
            group = [p for p in owners if len(p) == n]
            table = np.array([[self.ids[w] for w in p] for p in group], np.int64)
            self.by_length.append((n, table, [sorted(owners[p]) for p in group]))


def _runs(ids: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexed sequence (runs of vocabulary words, each followed by 1) and the word each place stands for."""
    known = ids > 0
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((known[1:] != known[:-1]) | (doc[1:] != doc[:-1])) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(ids)]])
    ok = known[lo] & (hi - lo >= shortest)
    lo, hi = lo[ok], hi[ok]
    size = hi - lo + 1
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(lo, size)
    end = np.zeros(len(place), bool)
    end[first + size - 1] = True
    return np.where(end, 1, ids[np.minimum(place, len(ids) - 1)]), np.where(end, -1, place)


def occurrences(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list]:
    """Per word whether it is hit, and (document, owners) of every occurrence."""
    mark = np.zeros(len(ids) + 1, np.int64)
    owners: list[tuple[np.ndarray, np.ndarray, list]] = []
    seq, place = _runs(ids, doc, phrases.shortest)
    if len(seq):
        index = FmIndex(seq, phrases.symbols)
        for n, table, who in phrases.by_length:
            lo, hi = index.search(table)
            count = hi - lo
            total = int(count.sum())
            if not total:
                continue
            rows = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            start = place[index.locate(rows)]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + n, -1)
            owners.append((doc[start], np.repeat(np.arange(len(table)), count), who))
    return np.cumsum(mark[:-1]) > 0, doc, owners


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", k: int = PHRASE, with_text: bool = True) -> DataFrame:
    """Every document with a `contamination` struct: n_words, n_hit, items, clean_text (spans cut out).

    `with_text=False` leaves clean_text null where only the counts are wanted.
    """
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    if n_blocks > 1:
        return _in_blocks(docs, bench, n_blocks, text, k, with_text)
    sent = _send(docs, bench) if n_blocks else None

    def judge(batch: pa.RecordBatch) -> pa.Array:
        raw = texts(batch, text)
        lists = [fold(t).split() for t in raw]
        hit, found = _search(lists, *sent, k) if sent else (np.zeros(sum(map(len, lists)), bool), [set() for _ in raw])
        return _results(raw, lists, hit, found, with_text)

    return append_struct(docs, RESULT, FIELDS, judge, text, SHARD_BYTES)


def _send(docs: DataFrame, bench: DataFrame) -> tuple[str, Broadcast]:
    """One block of the benchmark, with a name under which workers keep its phrases."""
    rows = [(r.i, r.t.encode()) for r in bench.toLocalIterator()]
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(rows)


def _search(lists: list[list[bytes]], name: str, block: Broadcast, k: int) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a shard's documents a block hits, and the items found in each document."""
    counts = np.array([len(x) for x in lists], np.int64)
    doc = np.repeat(np.arange(len(lists)), counts)
    found: list[set[str]] = [set() for _ in lists]
    phrases = _phrases(name, block, k)
    if not phrases.by_length:
        return np.zeros(len(doc), bool), found
    get = phrases.ids.get
    ids = np.fromiter((get(w, 0) for x in lists for w in x), np.int64, len(doc))
    hit, _, owners = occurrences(ids, doc, phrases)
    for where, which, who in owners:
        for d, p in set(zip(where.tolist(), which.tolist(), strict=True)):
            found[d].update(who[p])
    return hit, found


def _results(raw: list[bytes], lists: list[list[bytes]], hit: np.ndarray, found: list[set[str]], with_text: bool) -> pa.Array:
    rows, at = [], 0
    for t, words, items in zip(raw, lists, found, strict=True):
        own = hit[at : at + len(words)]
        at += len(words)
        n = int(own.sum())
        rows.append({"n_words": len(words), "n_hit": n, "items": sorted(items),
                     "clean_text": (cut(t, own) if n else t).decode("utf-8", "replace") if with_text else None})
    return pa.array(rows, _ARROW)


def _in_blocks(docs: DataFrame, bench: DataFrame, n_blocks: int, text: str, k: int, with_text: bool) -> DataFrame:
    """The same for a benchmark of several blocks; equal texts share their hits."""
    held = []
    for b in range(n_blocks):
        name, block = _send(docs, bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b))

        def find(batches: Iterator[pa.RecordBatch], name: str = name, block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "t", SHARD_BYTES):
                lists = [fold(t).split() for t in texts(part, "t")]
                hit, found = _search(lists, name, block, k)
                ends = np.cumsum([len(x) for x in lists])
                marks = np.split(hit, ends[:-1])
                some = [i for i, m in enumerate(marks) if m.any()]
                yield pa.RecordBatch.from_arrays([
                    part.column("_k").take(pa.array(some, pa.int64())), pa.array([np.packbits(marks[i]).tobytes() for i in some], pa.binary()),
                    pa.array([sorted(found[i]) for i in some], pa.list_(pa.string()))], names=["_k", "_hit", "_items"])

        held.append(settle_table(docs.select(text_hash(text).alias("_k"), F.col(text).alias("t")).mapInArrow(find, "_k binary, _hit binary, _items array<string>").groupBy("_k").agg(
            F.first("_hit").alias("_hit"), F.first("_items").alias("_items"))))
        block.destroy()
    every = reduce(DataFrame.unionByName, held).groupBy("_k").agg(F.collect_list("_hit").alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    keep = others(docs, RESULT, "_k", "_hits", "_items")
    told = docs.select(*cols(keep), text_hash(text).alias("_k")).join(every, "_k", "left").select(*cols(keep), "_hits", "_items")

    def judge(batch: pa.RecordBatch) -> pa.Array:
        raw = texts(batch, text)
        lists = [fold(t).split() for t in raw]
        hit = [np.zeros(0, bool)]
        for words, marks in zip(lists, batch.column("_hits").to_pylist(), strict=True):
            own = np.zeros(len(words), bool)
            for m in marks or ():
                own |= np.unpackbits(np.frombuffer(m, np.uint8))[: len(words)].astype(bool)
            hit.append(own)
        return _results(raw, lists, np.concatenate(hit), [set(x or ()) for x in batch.column("_items").to_pylist()], with_text)

    return append_struct(told, RESULT, FIELDS, judge, text, SHARD_BYTES).select(*cols(keep), RESULT)


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("clean_text", pa.string())])
_held: dict = {}


def _phrases(name: str, block: Broadcast, k: int) -> Phrases:
    """The phrase table of a block; a worker keeps the last one it used."""
    if (name, k) not in _held:
        _held.clear()
        _held[name, k] = Phrases(block.value, k)
    return _held[name, k]


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit spans, each from its first to its last word."""
    where = [m.span() for m in _WORD.finditer(fold(text))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, text[at:]])
