"""Suffix-array dedup: byte strings of SIZE bytes that start anywhere else are found by suffix order.

The corpus is too large for one suffix array, so suffixes are first dealt to places where equal ones
must meet. Of the GRAM-byte strings inside a window of SIZE bytes the one with the smallest hash is
its anchor; equal windows have equal anchors at equal places. The windows of one anchor occurrence
follow each other; together they are a context of less than twice SIZE bytes.

1. Contexts are listed as (anchor hash, context hash, count). Anchors met once are done. A context met
   twice repeats as a whole.
2. Where an anchor has different contexts, one copy of each is sent to the anchor's bucket. The bucket
   sorts the suffixes that start at its anchors and, read backwards, the prefixes that end there, both
   with the lengths of common prefixes of neighbours. Two windows are equal if the suffix order names
   their right parts alike and the prefix order their left parts. A run of equal windows goes on by
   place: the previous smaller place is the neighbour before (a next smaller one cannot follow), so the
   longest previous factor of a window reaches SIZE if it has such a neighbour, and its longest
   following factor if there is one after it.
3. An anchor with more than HOT different contexts (a passage in very many texts) has no bucket: its
   windows go by their own hash, so its work is dealt by content again and equal windows of a block
   collapse before they travel.

Blocks of documents take the verdicts back and cut the text. The text is shuffled once, for the sending
and the cutting, which read the same exchange.

keep="none" removes every copy; keep="first" leaves what starts first in (id, byte) order; `later=True` also
counts what keep="first" would remove (n_removed_later, else null), from the same pass. Defined results: a null text counts as empty; texts shorter than SIZE keep all; a null id comes last; repeated
rows are copies of each other (under keep="first" rows that share id and text share one place, and all
of them stay); an empty table gives an empty result. Extra columns pass through; a column named like
the result is replaced, and the working name _block is left out. Removed bytes may cut a character; clean_text shows such cuts as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import texts
from .shared import cols, others, settle_table, small_batches
from .substring_dedup import LAST, _mix, _slices, pack, pack_sorted, unpack, unpack_sorted

SIZE = 400
GRAM = 32
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18
BUCKET = 8192
HOT = 256
RESULT = "suffix_dedup"
FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_removed_later", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("clean_text", T.StringType()),
    T.StructField("kept_sha256", T.StringType()),
])
_ARROW = pa.struct([
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_removed_later", pa.int64()), ("n_spans", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("clean_text", pa.string()), ("kept_sha256", pa.string())])
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Chunk:
    """Some whole documents laid end to end: range hashes by prefix sums, and the runs of each anchor."""

    def __init__(self, docs: list[bytes], size: int):
        self.size = size
        self.lengths = np.array([len(d) for d in docs], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(docs), np.uint8)
        n = len(self.data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=self.sums[1:])
        self.lo = self.n = self.anchor = np.zeros(0, np.int64)
        self.a = np.zeros(0, np.uint64)
        edge = np.zeros(n + 1, np.int64)
        long_ = self.lengths >= size
        if long_.any():
            np.add.at(edge, self.begins[long_], 1)
            np.add.at(edge, self.begins[long_] + self.lengths[long_] - size + 1, -1)
            self._runs(np.flatnonzero(np.cumsum(edge[:-1])), min(GRAM, size))

    def hashes(self, lo: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Place-free hashes of byte ranges."""
        return _mix((self.sums[lo + length] - self.sums[lo]) * self.down[lo] + _U(1))

    def _runs(self, starts: np.ndarray, gram: int) -> None:
        w = self.size - gram + 1
        m = len(self.data) - gram + 1
        grams = self.hashes(np.arange(m), gram)
        keys = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        keys[:m] = grams >> _U(32) << _U(32) | np.arange(m, dtype=np.uint64)
        rows = keys.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[starts], ahead[starts + w - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        self.lo, self.anchor = starts[first], at[first]
        self.n = np.diff(np.append(first, len(starts)))
        self.a = grams[self.anchor]

    def contexts(self) -> np.ndarray:
        """One hash per run: the bytes of all its windows and where the anchor stands in them."""
        h = self.hashes(self.lo, self.n + self.size - 1)
        return _mix(h + (self.anchor - self.lo).astype(np.uint64) * _U(0x8CB92BA72F3D8DD7))

    def windows(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, key, check) of every window of the given runs."""
        n = self.n[run]
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.lo[run], n)
        h = self.hashes(start, self.size)
        a = np.repeat(self.a[run], n)
        return start, h, (_mix(a ^ h) >> _U(32)).astype(np.uint32)


def _chunks(batch: pa.Table, text: str, size: int, limit: int = CHUNK):
    """(first row, chunk) over the rows of a block."""
    docs, held, first, row = [], 0, 0, 0
    for part in batch.select([text]).to_batches():
        for t in texts(part, text):
            if docs and held + len(t) > limit:
                yield first, Chunk(docs, size)
                docs, held, first = [], 0, row
            docs.append(t)
            held += len(t)
            row += 1
    if docs:
        yield first, Chunk(docs, size)


def _ids(batch: pa.Table, id_: str) -> np.ndarray:
    return batch.column(id_).cast(pa.int64()).fill_null(int(LAST)).to_numpy()


# --- suffix order of a bucket ---------------------------------------------------------------------
def order_names(group: np.ndarray, strings: list[bytes], depth: int) -> np.ndarray:
    """names[i, d]: equal for strings of one group that agree on d bytes, from their order and common prefixes."""
    n = len(strings)
    order = sorted(range(n), key=lambda i: (group[i], strings[i]))
    table = np.frombuffer(b"".join([strings[i].ljust(depth, b"\0") for i in order]), np.uint8).reshape(n, depth)
    common = np.full(n, -1)
    unlike = table[1:] != table[:-1]
    common[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), depth)
    sorted_group = group[order]
    common[1:][sorted_group[1:] != sorted_group[:-1]] = -1
    names = np.empty((n, depth + 1), np.int32)
    names[order] = np.cumsum(common[:, None] < np.arange(depth + 1), axis=0, dtype=np.int32)
    return names


def factors(anchors: np.ndarray, places: np.ndarray, contexts: list[bytes], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per context, in place order: which windows have an earlier match, and which have any.

    `places` is where the anchor stands in each context.
    """
    gram = min(GRAM, size)
    right = order_names(anchors, [c[p : p + size] for c, p in zip(contexts, places.tolist(), strict=True)], size)
    left = order_names(anchors, [c[max(0, p - size) : p][::-1] for c, p in zip(contexts, places.tolist(), strict=True)], size - gram)
    n = np.array([len(c) for c in contexts], np.int64) - size + 1
    which = np.repeat(np.arange(len(contexts)), n)
    before = places[which] - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))  # bytes ahead of the anchor
    k = len(contexts) + 1
    name = (before * k + left[which, before]) * k + right[which, size - before]
    order = np.argsort(name, kind="stable")  # runs of equal windows, each by place
    same = name[order][1:] == name[order][:-1]
    earlier, later = np.zeros(len(name), bool), np.zeros(len(name), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    cut = np.cumsum(n)[:-1]
    return np.split(earlier, cut), np.split(earlier | later, cut)


# --- the operator ---------------------------------------------------------------------------------
def dedup_suffixes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, keep: str = "none",
                   block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, hot: int = HOT, with_text: bool = True, later: bool = False) -> DataFrame:
    """Every document with a `suffix_dedup` struct: n_bytes, n_removed, n_removed_later, n_spans, spans, clean_text, kept_sha256.

    A byte goes if a string of `size` bytes that covers it also starts anywhere else (keep="none"), or
    also starts earlier (keep="first"). `with_text=False` leaves clean_text and spans null.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    columns = others(docs, RESULT, "_block")
    dealt = docs.select(*cols(columns), F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(blocks)).alias("_block"))
    first = keep == "first"
    placed = first or later  # first places are needed
    modes = [first, True] if later else [first]  # whether the first place stays, for each result

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table(batch)
            ids, block = _ids(rows, id), rows["_block"].to_numpy()
            for row, chunk in _chunks(rows, text, size):
                doc = np.searchsorted(chunk.begins + chunk.lengths, chunk.lo, "right")
                zero = np.zeros(len(doc), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block[row + doc]), pa.array(chunk.a.view(np.int64)), pa.array(chunk.contexts().view(np.int64)),
                    pa.array(ids[row + doc] if placed else zero), pa.array(chunk.lo - chunk.begins[doc] if placed else zero),
                    pa.array(chunk.n.astype(np.int32))], names=["_block", "a", "c", "id", "at", "windows"])

    with small_batches(docs.sparkSession):
        found = settle_table(dealt.select(id, text, "_block").mapInArrow(listed, "_block long, a long, c long, id long, at long, windows int"))
    met = found.groupBy("a").count().filter("count > 1").select("a")
    found = settle_table(found.join(met, "a", "left_semi"))
    contexts = found.groupBy("a", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("place"), F.min("_block").alias("_block"), F.max("windows").alias("windows"))
    kinds = contexts.groupBy("a").agg(F.count("*").alias("kinds"))
    repeated = settle_table(contexts.join(kinds, "a").filter("n > 1 OR kinds > 1"))
    spot = [F.col("place.id").alias("id"), F.col("place.at").alias("at")]
    busy = found.select("_block", "a").distinct().join(repeated.filter(F.col("kinds") > hot).select("a").distinct(), "a").select("_block", "a")
    none = F.lit(None).cast("long")
    asks = repeated.filter((F.col("kinds") > 1) & (F.col("kinds") <= hot)).select("_block", F.lit(0).alias("kind"), "a", "c", *spot, "n").unionByName(
        busy.select("_block", F.lit(1).alias("kind"), "a", none.alias("c"), none.alias("id"), none.alias("at"), none.alias("n")))
    sizes = repeated.agg(
        F.count_if((F.col("kinds") > 1) & (F.col("kinds") <= hot)).alias("unlike"),
        F.sum(F.when(F.col("kinds") > hot, F.col("n") * F.col("windows"))).alias("busy")).first()
    buckets, shards = max(1, sizes.unlike // bucket), max(1, (sizes.busy or 0) >> 21)

    def send(batch: pa.Table, ask: pa.Table) -> pa.Table:
        """Bytes of one copy of each asked context, and window hashes of busy ones."""
        out, seen, hashes = [], set(), []
        if batch.num_rows and ask.num_rows:
            wanted, crowd = _wanted(ask)
            ids = _ids(batch, id)
            for row, chunk in _chunks(batch, text, size):
                c = chunk.contexts()
                known, who, at, times = wanted.find(chunk.a, c)
                for r in np.flatnonzero(known).tolist():
                    if (key := (int(chunk.a[r]), int(c[r]))) not in seen:
                        seen.add(key)
                        lo = int(chunk.lo[r])
                        out.append((0, _bucket(key[0], buckets), *key, int(chunk.anchor[r]) - lo, int(who[r]), int(at[r]), int(times[r]),
                                    chunk.data[lo : lo + int(chunk.n[r]) + size - 1].tobytes(), None, None))
                start, h, g = chunk.windows(np.flatnonzero(np.isin(chunk.a, crowd)))
                doc = np.searchsorted(chunk.begins + chunk.lengths, start, "right")
                hashes.append((h, g, ids[row + doc], start - chunk.begins[doc]))
            h, g, who, at = (np.concatenate(x) for x in zip(*hashes, strict=True))
            order = np.lexsort((at, who, g, h))
            h, g, who, at = h[order], g[order], who[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
            twice = np.diff(np.append(new, len(h))) > 1
            h, g, who, at = h[new], g[new], who[new], at[new]
            shard = (h >> _U(32)) * _U(shards) >> _U(32)
            for s, lo, hi in _slices(shard):
                body = pack_sorted(h[lo:hi]), pack(g[lo:hi]), b"".join(
                    len(x).to_bytes(4, "little") + x for x in (pack(np.packbits(twice[lo:hi])), pack(who[lo:hi]), pack(at[lo:hi])))
                out.append((1, s, 0, 0, 0, 0, 0, 0, *body))
        block = batch["_block"][0].as_py() if batch.num_rows else None
        return pa.table({
            "_block": pa.array([block] * len(out), pa.int64()), "kind": pa.array([r[0] for r in out], pa.int32()),
            "part": pa.array([r[1] for r in out], pa.int64()),
            "a": np.array([r[2] for r in out], np.uint64).view(np.int64), "c": np.array([r[3] for r in out], np.uint64).view(np.int64),
            **{k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("p", "id", "at", "n"), 4)},
            **{k: pa.array([r[i] for r in out], pa.binary()) for i, k in enumerate(("x", "y", "z"), 8)}})

    sent = dealt.groupBy("_block").cogroup(asks.groupBy("_block")).applyInArrow(
        send, "_block long, kind int, part long, a long, c long, p long, id long, at long, n long, x binary, y binary, z binary")

    def judge(batch: pa.Table) -> pa.Table:
        if batch["kind"][0].as_py():
            return exact(batch)
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("id", "ascending"), ("at", "ascending")]))
        earlier, some = factors(batch["a"].to_numpy(), batch["p"].to_numpy(), batch["x"].to_pylist(), size)
        # where every copy goes, a context met twice goes as a whole
        hit = np.array([m.any() for m in some], bool) & (placed | (batch["n"].to_numpy() < 2))
        kept = batch.filter(pa.array(hit))
        empty = pa.nulls(kept.num_rows, pa.binary())
        masks = [pa.array([pack(np.packbits(m)) for m, y in zip(told, hit, strict=True) if y], pa.binary()) for told in (some, earlier)]
        return pa.table({"_block": kept["_block"], "kind": pa.array([1] * kept.num_rows, pa.int32()), "a": kept["a"], "c": kept["c"],
                         "x": masks[0], "y": masks[1] if placed else empty, "z": empty})

    def exact(batch: pa.Table) -> pa.Table:
        """Of the window hashes of one range: which repeat, and where each starts first."""
        hs = [unpack_sorted(x, np.uint64) for x in batch["x"].to_pylist()]
        h, g = np.concatenate(hs), np.concatenate([unpack(x, np.uint32) for x in batch["y"].to_pylist()])
        rest = [_three(z) for z in batch["z"].to_pylist()]
        twice = np.concatenate([np.unpackbits(unpack(t, np.uint8))[: len(x)] for (t, _, _), x in zip(rest, hs, strict=True)]).astype(bool)
        who = np.concatenate([unpack(w, np.int64) for _, w, _ in rest])
        at = np.concatenate([unpack(w, np.int64) for _, _, w in rest])
        owner = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        order = np.lexsort((at, who, g, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        many = (np.diff(np.append(start, len(h))) > 1) | np.logical_or.reduceat(twice[order], start)
        lead = order[start][group]
        hit, w0, a0 = np.zeros(len(h), bool), np.empty_like(who), np.empty_like(at)
        hit[order], w0[order], a0[order] = many[group], who[lead], at[lead]
        names, rows = batch["_block"].to_pylist(), []
        for b, lo, hi in _slices(owner):
            y = hit[lo:hi]
            if y.any():
                rows.append((names[b], pack_sorted(h[lo:hi][y]), pack(w0[lo:hi][y]), pack(a0[lo:hi][y])))
        return pa.table({"_block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([2] * len(rows), pa.int32()),
                         "a": pa.array([0] * len(rows), pa.int64()), "c": pa.array([0] * len(rows), pa.int64()),
                         **{k: pa.array([r[i] for r in rows], pa.binary()) for i, k in enumerate(("x", "y", "z"), 1)}})

    verdicts = sent.groupBy("kind", "part").applyInArrow(judge, "_block long, kind int, a long, c long, x binary, y binary, z binary")
    if placed:  # a mask holds for every copy of its context
        masks = found.select("_block", "a", "c").distinct().join(verdicts.filter("kind = 1").drop("_block"), ["a", "c"])
        verdicts = verdicts.filter("kind = 2").unionByName(masks)

    # what each block is told: 0 a whole context (with its first place), 1 windows of a context, 2 window hashes, 3 busy anchors
    nothing = [F.lit(None).cast("binary").alias(x) for x in "xyz"]
    whole = repeated.filter("n > 1").select("a", "c", *spot)
    told = found.select("_block", "a", "c").distinct().join(whole, ["a", "c"]).select("_block", F.lit(0).alias("kind"), "a", "c", "id", "at", *nothing)
    told = told.unionByName(verdicts.withColumns({"id": none, "at": none})).unionByName(
        busy.select("_block", F.lit(3).alias("kind"), "a", none.alias("c"), none.alias("id"), none.alias("at"), *nothing))

    schema = T.StructType([*[f for f in docs.schema.fields if f.name in columns], T.StructField(RESULT, FIELDS, True)])

    def cut(batch: pa.Table, tell: pa.Table) -> pa.Table:
        ids = _ids(batch, id)
        place, mask, late, crowd = _told(tell)
        rows = []
        for row, chunk in _chunks(batch, text, size):
            c = chunk.contexts()
            edges = [np.zeros(len(chunk.data) + 1, np.int64) for _ in modes]
            known, p_id, p_at = place.find(chunk.a, c)
            doc = np.searchsorted(chunk.begins + chunk.lengths, chunk.lo, "right")
            other = (p_id != ids[row + doc]) | (p_at != chunk.lo - chunk.begins[doc])
            for edge, stays in zip(edges, modes, strict=True):
                gone = known & other if stays else known
                np.add.at(edge, chunk.lo[gone], 1)
                np.add.at(edge, (chunk.lo + chunk.n + size - 1)[gone], -1)
            if mask:
                for r, key in enumerate(zip(chunk.a.tolist(), c.tolist(), strict=True)):
                    if (m := mask.get(key)) is not None:
                        for edge, stays in zip(edges, modes, strict=True):
                            s = chunk.lo[r] + np.flatnonzero(m[int(stays)][: chunk.n[r]])
                            np.add.at(edge, s, 1)
                            np.add.at(edge, s + size, -1)
            if late is not None:
                start, h, _ = chunk.windows(np.flatnonzero(np.isin(chunk.a, crowd)))
                at = np.minimum(np.searchsorted(late[0], h), len(late[0]) - 1)
                hit = late[0][at] == h
                doc = np.searchsorted(chunk.begins + chunk.lengths, start, "right")
                other = (late[1][at] != ids[row + doc]) | (late[2][at] != start - chunk.begins[doc])
                for edge, stays in zip(edges, modes, strict=True):
                    gone = hit & other if stays else hit
                    np.add.at(edge, start[gone], 1)
                    np.add.at(edge, start[gone] + size, -1)
            gone = [np.cumsum(edge[:-1]) > 0 for edge in edges]
            for b, n in zip(chunk.begins.tolist(), chunk.lengths.tolist(), strict=True):
                rows.append(_row(chunk.data[b : b + n], gone[0][b : b + n], gone[1][b : b + n] if later else None, with_text))
        return pa.table([*[batch.column(x) for x in columns], pa.array(rows, _ARROW)], names=[*columns, RESULT])

    return dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(cut, schema)


def _row(data: np.ndarray, gone: np.ndarray, later: np.ndarray | None, with_text: bool) -> dict:
    kept = data[~gone].tobytes()
    step = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    spans = [{"start": s, "end": e} for s, e in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)]
    return {"n_bytes": len(data), "n_removed": int(gone.sum()), "n_removed_later": None if later is None else int(later.sum()), "n_spans": len(spans), "spans": spans if with_text else None,
            "clean_text": kept.decode("utf-8", "replace") if with_text else None, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _three(z: bytes) -> list[bytes]:
    out, at = [], 0
    for _ in range(3):
        n = int.from_bytes(z[at : at + 4], "little")
        out.append(z[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class _Pairs:
    """Sorted (a, c) pairs with values, looked up by whole arrays."""

    def __init__(self, a: np.ndarray, c: np.ndarray, *values: np.ndarray):
        key = _mix(a) + c
        order = np.argsort(key)
        self.key, self.values = key[order], [v[order] for v in values]

    def find(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.key) or not len(a):
            return np.zeros(len(a), bool), *[np.zeros(len(a), v.dtype) for v in self.values]
        key = _mix(a) + c
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, *[v[at] for v in self.values]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].fill_null(0).to_numpy()


def _wanted(ask: pa.Table) -> tuple[_Pairs, np.ndarray]:
    """Contexts whose bytes are asked for, and busy anchors."""
    whole = _column(ask, "kind") == 0
    a, c = _column(ask, "a").view(np.uint64), _column(ask, "c").view(np.uint64)
    return _Pairs(a[whole], c[whole], *[_column(ask, x)[whole] for x in ("id", "at", "n")]), a[~whole]


def _bucket(anchor: int, buckets: int) -> int:
    """Anchors are the smallest hashes of their windows, so they are hashed again before they are dealt."""
    return xxhash.xxh3_64_intdigest(anchor.to_bytes(8, "little")) % buckets


def _told(tell: pa.Table) -> tuple[_Pairs, dict, tuple | None, np.ndarray]:
    kind = _column(tell, "kind") if tell.num_rows else np.zeros(0, np.int32)
    a, c = (_column(tell, x).view(np.uint64) if tell.num_rows else np.zeros(0, np.uint64) for x in ("a", "c"))
    who, at = (_column(tell, x) if tell.num_rows else np.zeros(0, np.int64) for x in ("id", "at"))
    place = _Pairs(a[kind == 0], c[kind == 0], who[kind == 0], at[kind == 0])
    crowd = a[kind == 3]
    mask: dict = {}
    parts = []
    for i in np.flatnonzero((kind == 1) | (kind == 2)).tolist():
        if kind[i] == 1:
            mask[int(a[i]), int(c[i])] = tuple(np.unpackbits(unpack(m, np.uint8)) if (m := tell[k][i].as_py()) else None for k in "xy")
        else:
            parts.append((unpack_sorted(tell["x"][i].as_py(), np.uint64), unpack(tell["y"][i].as_py(), np.int64), unpack(tell["z"][i].as_py(), np.int64)))
    if not parts:
        return place, mask, None, crowd
    h, w, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    return place, mask, (h[order], w[order], p[order]), crowd
