"""SimHash near-dedup: 64-bit fingerprints, joined to themselves by a binary trie under a Hamming budget.

Equal fingerprints collapse first. For a budget of 2 the 64 bits are cut in three parts; of two
linked fingerprints one part is equal, so each fingerprint goes to three buckets, by the value of each
part. A bucket that holds more than `BUCKET` fingerprints is cut again by the bits still free, up to
three times; then 45 bits are fixed and a bucket cannot hold more than 2^19 distinct fingerprints,
at any corpus size. Inside a bucket the trie of the free bits is walked in node pairs: differing bits
add up and a pair is left as soon as the budget is exceeded. A bucket reports a spanning forest of its
links, never its pairs, so what it sends is linear in what it got.

Defined results: letters A-Z are lower-cased; a text of fewer words than a shingle is one shingle; a
null or empty text has fingerprint zero and links like any other; repeated rows share a class; the
class id is the smallest non-null id (null if there is none); an empty table gives an empty result.
`fingerprints` passes extra columns through and replaces `simhash`; `near_duplicates` returns three columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import chunks, texts
from .shared import cols, components, others, settle

SHINGLE = 3
BUDGET = 2
SEED = 42
BUCKET = 8192
PARTS = BUDGET + 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.translate(_FOLD).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint_of(lists: list[list[bytes]]) -> np.ndarray:
    """One fingerprint per list of shingles: a bit is set if it is in over half of the hashes."""
    size = np.array([len(x) for x in lists], np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for x in lists for s in x), ">u8", int(size.sum()))
    out = np.zeros(len(lists), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    starts = (np.cumsum(size) - size)[full]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > size[full][:, None], axis=1)
    out[full] = np.ascontiguousarray(packed).view(">u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """All columns, and `simhash` as a signed long."""
    keep = others(docs, "simhash")
    df = docs.select(*cols(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 4 << 20):
            f = fingerprint_of([shingles(t, k) for t in texts(part, text)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f.view(np.int64))], names=[*keep, "simhash"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("simhash", T.LongType())]))


# --- masks ----------------------------------------------------------------------------------------
def _parts(mask: int) -> list[int]:
    """The mask with one more third of its free bits fixed, in every way."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // PARTS for i in range(PARTS + 1)]
    return [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(PARTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once per finer mask of the mask it stands in; `masks` are those in use."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in _parts(m)]))])
    return rows.select("f", F.explode(finer[F.col("mask")]).alias("mask")).withColumn(
        "value", F.col("f").bitwiseAND(F.col("mask")))


# --- the trie self-join ---------------------------------------------------------------------------
class Forest:
    """Union of links over 0..n-1, kept as parents; whole arrays of links are merged at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            r = self.roots()
            a, b = r[i], r[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(keys: np.ndarray, free: int, forest: Forest, budget: int = BUDGET, limit: int = 1 << 19) -> None:
    """Link sorted distinct keys that agree above their `free` low bits and differ in `budget` bits at most.

    A node is a range of keys. Node pairs go down one bit together; a pair of two single keys is
    settled at once by the bits that are left.
    """
    n = len(keys)
    top = keys >> np.uint64(free) if free < 64 else np.zeros(n, np.uint64)
    lo = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1])
    hi = np.append(lo[1:], n)
    big = hi - lo > 1
    ones: dict[int, np.ndarray] = {}
    zero = np.zeros(int(big.sum()), np.int64)
    stack = [(free - 1, lo[big], hi[big], lo[big], hi[big], zero)]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if not len(alo):
            continue
        if len(alo) > limit:
            for s in (slice(0, len(alo) // 2), slice(len(alo) // 2, None)):
                stack.append((bit, alo[s], ahi[s], blo[s], bhi[s], err[s]))
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
        c = ones[bit]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        nxt = [np.concatenate(x) for x in zip(
            (alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1),
            tuple(x[~own] for x in (am, ahi, blo, bm, err + 1)), strict=True)]
        alo, ahi, blo, bhi, err = nxt
        na, nb = ahi - alo, bhi - blo
        ok = (na > 0) & (nb > 0) & (err <= budget) & ((alo != blo) | (na > 1))
        alo, ahi, blo, bhi, err, na, nb = (x[ok] for x in (alo, ahi, blo, bhi, err, na, nb))
        single = (na == 1) & (nb == 1)
        i, j = alo[single], blo[single]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        forest.link(i[near], j[near])
        if bit:
            more = ~single
            stack.append((bit - 1, alo[more], ahi[more], blo[more], bhi[more], err[more]))


def _bring_up(keys: np.ndarray, mask: int) -> np.ndarray:
    """Keys with the bits of the mask first, the free bits after them."""
    order = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out = np.zeros_like(keys)
    for b in order:
        out = out << np.uint64(1) | (keys >> np.uint64(b) & np.uint64(1))
    return out


def bucket_links(batch: pa.Table) -> pa.Table:
    """A spanning forest of the links in a set of buckets, as (a, b) with b the root of a's tree."""
    f = batch["f"].to_numpy().view(np.uint64)
    masks = batch["mask"].to_numpy()
    a, b = [], []
    for m in np.unique(masks):
        mask = int(m) & (2**64 - 1)
        own = np.unique(f[masks == m])  # two ways of cutting may fix the same bits
        up = _bring_up(own, mask)
        order = np.argsort(up)
        own, up = own[order], up[order]
        forest = Forest(len(own))
        trie_links(up, 64 - mask.bit_count(), forest)
        root = forest.roots()
        linked = root != np.arange(len(own))
        a.append(own[linked])
        b.append(own[root[linked]])
    return pa.table({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links between distinct fingerprints (column f) that connect all within the budget."""
    n = max(1, prints.count())
    rows = prints.select("f", F.lit(0).cast("long").alias("mask"))
    masks, ready = [0], []
    for level in range(3):
        rows = _dealt(rows, masks)
        masks = list(dict.fromkeys(p for m in masks for p in _parts(m)))
        if level < 2:
            large = rows.groupBy("mask", "value").count().filter(F.col("count") > bucket).select("mask", "value")
            if large.isEmpty():
                ready.append(rows)
                break
            large = settle(large)
            ready.append(rows.join(large, ["mask", "value"], "left_anti"))
            rows = rows.join(large, ["mask", "value"], "left_semi")
        else:
            ready.append(rows)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    groups = max(1, n * PARTS // bucket)
    every = every.select("f", "mask", F.pmod(F.xxhash64("mask", "value"), F.lit(groups)).alias("part"))
    return every.groupBy("part").applyInArrow(bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, simhash, component_id) of every document; the class id is the smallest id it can reach."""
    prints = settle(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("t")), "t", k).select("id", "simhash"))
    distinct = settle(prints.groupBy(F.col("simhash").alias("f")).agg(F.min("id").alias("least")))
    found = components(near_links(distinct.select("f")))
    rooted = distinct.join(found.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "least", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select(F.col("f").alias("simhash"), "component_id")
    return prints.join(classes, "simhash", "left").select(F.col("id").alias(id), "simhash", "component_id")
