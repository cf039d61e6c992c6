"""Substring dedup: a Count-min prefilter over word windows, then exact groups of what is left.

Documents are dealt to blocks of bounded size. Each block makes a partition sketch: for every sketch
row the cells its windows fall in, counted up to two. Sketches travel as sorted cell lists by cell
range, are merged there (counts of one cell add up, so merged counts can only overestimate), and each
block learns which of its own cells reach two documents. Only windows whose estimate, the minimum
over the rows, reaches two travel a second time, with a 96-bit key and the block's smallest document;
they are grouped exactly and blocks learn which of their windows start in an earlier document.

Nothing is broadcast: the merged sketch stays dealt by cell range and grows with the corpus, so the
load (windows per cell) is the same at every size. Copies inside a block collapse before they travel;
a window of a third of all documents costs its group one entry per block. The text is shuffled once:
all three passes read the same exchange.

Defined results: a null or empty text has no words; texts shorter than the window keep everything;
a null id counts as larger than every other id; repeated rows with one id do not remove each other;
an empty table gives an empty result. Extra columns pass through; one named like the result column is
replaced, and the working names _block, _id and _text are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import WordHashes, texts, word_hashes
from .shared import cols, others

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BITS = 22
LOAD = 4  # cells per window and sketch row, at least
ROWS = 2
LAST = np.int64(2**63 - 1)
RESULT = "dedup"
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
    T.StructField("kept_sha256", T.StringType()),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
_ZSTD = pa.Codec("zstd", 1)


# --- compact arrays -------------------------------------------------------------------------------
def pack(values: np.ndarray) -> bytes:
    """An integer array as byte planes, compressed: leading zero bytes cost next to nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes, kind: np.dtype | type) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(_ZSTD.decompress(data[4:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: np.dtype | type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


# --- windows of a block ---------------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (finaliser of a counter-based generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start places of all windows inside one document, a 64-bit hash and a 32-bit check of each."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    other = _mix(words)
    h, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        g = g * np.uint64(0xD1342543DE82EF95) + other[j : j + n]
    start = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return start, _mix(h[start]), (_mix(g[start]) >> np.uint64(32)).astype(np.uint32)


class Block:
    """Words and windows of one block; the same rows give the same arrays in every pass."""

    def __init__(self, batch: pa.Table, id_: str, text: str, k: int):
        self.raw = [t for b in batch.select([text]).to_batches() for t in texts(b, text)]
        seen = WordHashes()
        per_doc = [word_hashes(t.split(), seen) for t in self.raw]
        self.counts = np.array([len(x) for x in per_doc], np.int64)
        words = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(per_doc)), self.counts)
        ids = batch.column(id_).cast(pa.int64()).fill_null(int(LAST)).to_numpy()
        self.start, h, g = window_hashes(words, doc, k)
        self.owner = ids[doc[self.start]] if len(self.start) else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.h, self.g = hs[first], g[order][first]
        own = self.owner[order]
        self.min_id = np.minimum.reduceat(own, first) if len(first) else own
        self.many = self.min_id < (np.maximum.reduceat(own, first) if len(first) else own)
        self.group = np.empty(len(h), np.int64)  # distinct window of each window
        self.group[order] = np.cumsum(new) - 1

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells of a sketch row, sorted, and the cell number of every distinct window."""
        x = self.h if row == 0 else _mix(self.h + np.uint64(0x632BE59BD9B4E019 * row & (2**64 - 1)))
        return np.unique(x >> np.uint64(64 - bits), return_inverse=True)


def _slices(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, lo, hi) of each run of a sorted array."""
    if not len(keys):
        return []
    lo = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    hi = np.append(lo[1:], len(keys))
    return list(zip(keys[lo].tolist(), lo.tolist(), hi.tolist(), strict=True))


# --- the operator ---------------------------------------------------------------------------------
def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """Every document with a `dedup` struct: n_words, n_removed, kept_text, kept_sha256.

    A word goes if a k-word window that covers it also starts in a document with a smaller id.
    `with_text=False` leaves kept_text null where only the digest is wanted.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    bits = min(63, max(SHARD_BITS, int(LOAD * size // 5).bit_length()))
    hash_bits = max(1, bits - SHARD_BITS - 2)
    keep = others(docs, RESULT, "_block", "_id", "_text")
    dealt = docs.select(*cols(keep), F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(blocks)).alias("_block"))
    narrow = dealt.select(F.col(id).alias("_id"), F.col(text).alias("_text"), "_block") if len(keep) > 2 else dealt
    n_id, n_text = ("_id", "_text") if len(keep) > 2 else (id, text)

    def sketch(batch: pa.Table) -> pa.Table:
        block = Block(batch, n_id, n_text, k)
        out = []
        for row in range(ROWS):
            cells, of = block.cells(row, bits)
            twice = (np.bincount(of, minlength=len(cells)) > 1) | (np.bincount(of, block.many, len(cells)) > 0)
            for shard, lo, hi in _slices(cells >> np.uint64(SHARD_BITS)):
                part = (cells[lo:hi] & np.uint64((1 << SHARD_BITS) - 1)).astype(np.uint32)
                out.append((row, shard, pack_sorted(part), pack(np.packbits(twice[lo:hi]))))
        return _table(out, batch, ("row", pa.int32()), ("shard", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary()))

    sketches = narrow.groupBy("_block").applyInArrow(sketch, "_block long, row int, shard long, cells binary, twice binary")

    def merge(batch: pa.Table) -> pa.Table:
        count = np.zeros(1 << SHARD_BITS, np.uint8)
        parts = []
        for b, c, t in zip(batch["_block"].to_pylist(), batch["cells"].to_pylist(), batch["twice"].to_pylist(), strict=True):
            cells = unpack_sorted(c, np.uint32)
            add = np.unpackbits(unpack(t, np.uint8))[: len(cells)] + np.uint8(1)
            count[cells] = np.minimum(count[cells] + add, 2)
            parts.append((b, cells))
        rows = [(b, pack(np.packbits(count[cells] > 1))) for b, cells in parts if (count[cells] > 1).any()]
        first = batch.slice(0, 1)
        return pa.table({
            "_block": pa.array([b for b, _ in rows], pa.int64()),
            "row": pa.array(first["row"].to_pylist() * len(rows), pa.int32()),
            "shard": pa.array(first["shard"].to_pylist() * len(rows), pa.int64()),
            "hot": pa.array([x for _, x in rows], pa.binary())})

    merged = sketches.groupBy("row", "shard").applyInArrow(merge, "_block long, row int, shard long, hot binary")

    def candidates(batch: pa.Table, hot: pa.Table) -> pa.Table:
        out = []
        if batch.num_rows and hot.num_rows:
            block = Block(batch, n_id, n_text, k)
            told = {(r, s): x for r, s, x in zip(hot["row"].to_pylist(), hot["shard"].to_pylist(), hot["hot"].to_pylist(), strict=True)}
            likely = np.ones(len(block.h), bool)
            for row in range(ROWS):
                cells, of = block.cells(row, bits)
                high = np.zeros(len(cells), bool)
                for shard, lo, hi in _slices(cells >> np.uint64(SHARD_BITS)):
                    if (row, shard) in told:
                        high[lo:hi] = np.unpackbits(unpack(told[row, shard], np.uint8))[: hi - lo]
                likely &= high[of]
            h, g, ids = block.h[likely], block.g[likely], block.min_id[likely]
            for shard, lo, hi in _slices(h >> np.uint64(64 - hash_bits)):
                out.append((shard, pack_sorted(h[lo:hi]), pack(g[lo:hi]), pack(ids[lo:hi])))
        return _table(out, batch, ("shard", pa.int64()), ("h", pa.binary()), ("g", pa.binary()), ("ids", pa.binary()))

    likely = narrow.groupBy("_block").cogroup(merged.groupBy("_block")).applyInArrow(
        candidates, "_block long, shard long, h binary, g binary, ids binary")

    def exact(batch: pa.Table) -> pa.Table:
        owners = batch["_block"].to_pylist()
        hs = [unpack_sorted(x, np.uint64) for x in batch["h"].to_pylist()]
        h = np.concatenate(hs)
        g = np.concatenate([unpack(x, np.uint32) for x in batch["g"].to_pylist()])
        ids = np.concatenate([unpack(x, np.int64) for x in batch["ids"].to_pylist()])
        which = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        order = np.lexsort((g, h))
        hs_, gs = h[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], (hs_[1:] != hs_[:-1]) | (gs[1:] != gs[:-1])]))
        least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(h))))
        later = np.zeros(len(h), bool)
        later[order] = ids[order] > least
        rows = [(owners[b], pack_sorted(h[lo:hi][later[lo:hi]])) for b, lo, hi in _slices(which) if later[lo:hi].any()]
        return pa.table({"_block": pa.array([b for b, _ in rows], pa.int64()), "h": pa.array([x for _, x in rows], pa.binary())})

    repeats = likely.groupBy("shard").applyInArrow(exact, "_block long, h binary")

    schema = T.StructType([*[f for f in docs.schema.fields if f.name in keep], T.StructField(RESULT, FIELDS, True)])

    def remove(batch: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(batch, id, text, k)
        later = block.owner > block.min_id[block.group]
        if told.num_rows and len(later):
            known = np.sort(np.concatenate([unpack_sorted(x, np.uint64) for x in told["h"].to_pylist()]))
            at = np.minimum(np.searchsorted(known, block.h), len(known) - 1)
            later |= (known[at] == block.h)[block.group]
        edge = np.zeros(int(block.counts.sum()) + 1, np.int64)
        np.add.at(edge, block.start[later], 1)
        np.add.at(edge, block.start[later] + k, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows, at = [], 0
        for t, n in zip(block.raw, block.counts.tolist(), strict=True):
            own, at = gone[at : at + n], at + n
            words, lost = t.split(), int(own.sum())
            kept = b" ".join([w for w, x in zip(words, own.tolist(), strict=True) if not x] if lost else words)
            rows.append({"n_words": n, "n_removed": lost, "kept_text": kept.decode("utf-8", "replace") if with_text else None,
                         "kept_sha256": hashlib.sha256(kept).hexdigest()})
        cols = [batch.column(c) for c in keep]
        return pa.table([*cols, pa.array(rows, _ARROW)], names=[*keep, RESULT])

    return dealt.groupBy("_block").cogroup(repeats.groupBy("_block")).applyInArrow(remove, schema)


def _table(rows: list[tuple], batch: pa.Table, *columns: tuple[str, pa.DataType]) -> pa.Table:
    block = batch["_block"][0].as_py() if batch.num_rows else None
    data = {"_block": pa.array([block] * len(rows), pa.int64())}
    for i, (name, kind) in enumerate(columns):
        data[name] = pa.array([r[i] for r in rows], kind)
    return pa.table(data)
