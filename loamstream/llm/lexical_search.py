"""Ranked lexical search: a tree of documents' query terms, searched depth first under score bounds.

1. One pass over the documents counts, per document, its terms and the occurrences of those terms that
   queries use (its restricted vector). Number of documents, of terms, and the document frequencies of
   query terms follow from these rows by aggregation.
2. The vectors are read in shards. In a shard the terms of a vector stand in order of falling document
   frequency; vectors that begin alike share a path of a trie (paths without a branch are one edge, up
   to `LEAF` vectors that share a node's path are its leaf, equal vectors are one entry). Every node
   has, for each term below it, the largest count, and the smallest length norm m.
3. For each query the tree is searched depth first, best bound first: a node's bound is the score of
   its largest counts under its smallest norm. A subtree goes if its bound is below the k-th score so
   far, or equal and its smallest id not below the k-th. Tasks carry the k best from shard to shard.
4. The tasks' k best are ranked once more.

The queries are the stated set. They are answered in blocks of at most `BLOCK_BYTES` of text, one after
the other, so that what is broadcast (a block's words and weights) is bounded; the documents are read
once per block. Documents are not shuffled: their vectors are written once to the shared folder.

Scores are whole numbers: with N documents that have a term, L terms in all of them, n terms of a
document, a term's count tf, its document frequency df, w = floor(1000 ln((2N+2)/(2df+1))),
m = 75 + (25 n N) div L, the score is the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the query's
terms, repeats included.

Defined results: null and empty texts have no terms, are not counted and never found; a query without
known terms finds nothing; only scores above 0 are returned; equal scores go by ascending id, null ids
last; every row of the query table is answered on its own, also if ids repeat; repeated documents are
ranked each; without documents or queries the result is empty. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrowtext import chunks, fold_table, texts
from .shared import settle_table, small_batches

TOP = 20
BLOCK_BYTES = 4 << 20
LEAF = 16
POSTINGS = 1 << 20
_FOLD = fold_table(digits=True)
_LAST = 2**63 - 1


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# --- restricted vectors -----------------------------------------------------------------------------
def vectors(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(id, n, terms, tf) of every document with a term: its length, and its counts of the words sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value
        for part in chunks(batches, "text", 4 << 20):
            n, size, ids, tf, keep = [], [0], [], [], []
            for row, t in enumerate(texts(part, "text")):
                if not (own := terms(t)):
                    continue
                count = Counter(own)
                shared = [w for w in count if w in number] if len(count) < len(number) else [w for w in number if w in count]
                ids += [number[w] for w in shared]
                tf += [count[w] for w in shared]
                n.append(len(own))
                size.append(len(ids))
                keep.append(row)
            offsets = pa.array(size, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


# --- the tree ---------------------------------------------------------------------------------------
class Node:
    """Children (nodes, or id lists of equal vectors), and for each of them its terms with their gain.

    `terms`, `gain`: the children's terms one after the other, with the score of the largest count under
    the smallest norm; `start`: where each child's begin.
    """

    __slots__ = ("gain", "kids", "least", "start", "terms")

    def __init__(self, kids: list, parts: list[tuple], least: list[int]):
        self.kids, self.least = kids, least
        size = np.array([len(p[0]) for p in parts])
        self.start = np.cumsum(size) - size
        self.terms = np.concatenate([p[0] for p in parts])
        tf = np.concatenate([p[1] for p in parts])
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(np.array([p[2] for p in parts]), size))


def _union(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of all parts with their largest count, and the smallest norm."""
    term, tf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(term, kind="stable")
    term, tf = term[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    return term[first], np.maximum.reduceat(tf, first), min(p[2] for p in parts)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def tree(rows: list[tuple[np.ndarray, np.ndarray, int, int]]) -> Node | None:
    """Rows (terms in order of frequency, counts, norm, id), each with a term, as a tree."""
    if not rows:
        return None
    keyed = sorted(((r[0].astype(">u4").tobytes(), r[1].tobytes(), r[2], r[3], r) for r in rows), key=lambda x: x[:4])
    parts: list[tuple] = []
    ids: list[list[int]] = []
    last = None
    for a, b, m, id, row in keyed:
        if (a, b, m) != last:
            last = a, b, m
            parts.append(row[:3])
            ids.append([])
        ids[-1].append(id)
    lcp = np.array([-1, *(_common(x[0], y[0]) for x, y in zip(parts, parts[1:]))])

    def leaf(lo: int, hi: int) -> tuple[Node, tuple, int]:
        least = [x[0] for x in ids[lo:hi]]
        return Node(ids[lo:hi], parts[lo:hi], least), _union(parts[lo:hi]), min(least)

    def branches(lo: int, hi: int) -> list[tuple[int, int]]:
        """The subtrees at the shallowest branch of lo..hi; neighbours that fit into a leaf stay together."""
        inner = lcp[lo + 1 : hi]
        cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            if out and b - out[-1][0] <= LEAF:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
        return out

    made: dict[tuple[int, int], tuple[Node, tuple, int]] = {}
    todo = [(0, len(parts), False)]
    while todo:
        lo, hi, ready = todo.pop()
        if hi - lo <= LEAF:
            made[lo, hi] = leaf(lo, hi)
        elif not ready:
            todo.append((lo, hi, True))
            todo += [(a, b, False) for a, b in branches(lo, hi)]
        else:
            own = [made.pop(x) for x in branches(lo, hi)]
            made[lo, hi] = Node([x[0] for x in own], [x[1] for x in own], [x[2] for x in own]), _union([x[1] for x in own]), min(x[2] for x in own)
    return made[0, len(parts)][0]


def search(root: Node, weight: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
    """Depth first from the best bound; `best` is a heap of (score, -id) with the `top` best so far."""
    stack: list[tuple[int, int, Node]] = [(_LAST, -_LAST - 1, root)]
    while stack:
        bound, least, node = stack.pop()
        if len(best) == top and (bound, -least) <= best[0]:
            continue
        scores = np.add.reduceat(weight[node.terms] * node.gain, node.start)
        floor = best[0][0] if len(best) == top else 1
        for k in np.flatnonzero(scores >= max(1, floor)).tolist() if isinstance(node.kids[0], list) else ():
            score = int(scores[k])
            for id in node.kids[k]:
                if len(best) < top:
                    heapq.heappush(best, (score, -id))
                elif (score, -id) > best[0]:
                    heapq.heapreplace(best, (score, -id))
                else:
                    break
        if isinstance(node.kids[0], Node):
            ahead = np.flatnonzero(scores >= max(1, floor))
            for k in ahead[np.argsort(scores[ahead], kind="stable")].tolist():
                stack.append((int(scores[k]), node.least[k], node.kids[k]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with at most `POSTINGS` counts, or one row."""
    for batch in batches:
        ends = batch.column("terms").offsets.to_numpy()[1:] - batch.column("terms").offsets[0].as_py()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _rows(shard: pa.RecordBatch, rank: np.ndarray, n_docs: int, n_terms: int) -> list[tuple]:
    size = np.diff(shard.column("terms").offsets.to_numpy())
    term = rank[shard.column("terms").flatten().to_numpy()]
    tf = shard.column("tf").flatten().to_numpy()
    order = np.lexsort([term, np.repeat(np.arange(len(size)), size)])
    cuts = np.cumsum(size)[:-1]
    norms = [75 + 25 * n * n_docs // n_terms for n in shard.column("n").to_pylist()]
    ids = [_LAST if i is None else i for i in shard.column("id").to_pylist()]
    return list(zip(np.split(term[order], cuts), np.split(tf[order], cuts), norms, ids, strict=True))


def _found(vectors: DataFrame, sent: Broadcast, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, id, score): the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, queries = sent.value
        best: list[list] = [[] for _ in queries]
        for shard in _shards(batches):
            root = tree(_rows(shard, rank, n_docs, n_terms))
            weight = np.zeros(len(rank), np.int64)
            for (where, w), held in zip(queries, best, strict=True):
                weight[where] = w
                search(root, weight, held, top)
                weight[where] = 0
        rows = [(q, None if id == -_LAST else -id, score) for q, held in enumerate(best) for score, id in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["query", "id", "score"])

    return vectors.mapInArrow(run, "query long, id long, score long")


def _plan(queries: list[list[bytes]], words: dict[bytes, int], df: np.ndarray, n_docs: int) -> tuple[np.ndarray, list]:
    """Rank of each word by falling frequency; each query's ranks with their weights, repeats multiplied in."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(words))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()]
    out = []
    for q in queries:
        count = Counter(words[w] for w in q)
        out.append((rank[list(count)] if count else np.zeros(0, np.int64), np.array([weight[i] * c for i, c in count.items()], np.int64)))
    return rank, out


def _empty(spark: SparkSession, item: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("item_id", item), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return spark.createDataFrame([], schema)


def search_documents(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                     item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    out = _empty(spark, items.schema["i"].dataType)
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # about block_bytes
        queries = [terms(r.t.encode()) for r in rows]
        words = {w: k for k, w in enumerate(sorted({w for q in queries for w in q}))}
        if not words:
            continue
        names = sc.broadcast(words)
        held = settle_table(vectors(docs, names))
        stats = held.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = np.zeros(len(words), np.int64)
        for r in held.select(F.explode("terms").alias("w")).groupBy("w").count().collect():  # a row per word of the block
            df[r.w] = r["count"]
        sent = sc.broadcast(_plan(queries, words, df, stats.n))
        with small_batches(spark, "32m"):
            found = settle_table(_found(held.filter("size(terms) > 0"), sent, stats.n, stats.l or 1, top))
        ranked = found.withColumn("rank", F.row_number().over(
            Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= top)
        own = spark.createDataFrame([(q, r.i) for q, r in enumerate(rows)], T.StructType([
            T.StructField("query", T.LongType()), T.StructField("item_id", items.schema["i"].dataType)]))
        out = out.union(ranked.join(own, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
        names.destroy()
        sent.destroy()
    return out
