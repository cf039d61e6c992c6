"""Near copies by exact similarity: texts whose sets of five-word shingles have Jaccard 0.8 or more.

1. Equal texts collapse first. Of each text 160 minima of its shingle hashes are taken; each four make a
   band, and texts that share one of the 40 bands are candidates: a pair of similarity 0.8 shares none
   with a chance of 7e-10, one of 0.9 with less than 1e-18. Classes that a caller `linked` before, as the
   pipeline does by fingerprints, are buckets beside them.
2. Every member of a bucket is compared with the bucket's smallest member. A group of many copies
   costs rows in proportion to its members, and mostly becomes one class here.
3. Buckets that still hold two classes are open. Their members form families (chained through open
   buckets); a family is dealt to tasks as slices of at most `SLICE` texts and `CELLS` shingles. A task
   gets a slice of the texts outside the family's largest class and a slice of the family, counts all
   their common shingles as a matrix product and returns a spanning forest of the links, never pairs. So
   each text is sent once per slice of such outsiders, whatever the number of pairs, and no link is
   left out. A family over `FAMILY` texts is dealt bucket by bucket instead.
4. A linked class that is still open may hold many texts that only share what rules their fingerprint, a
   line of dots say. It is cut into a bucket for each shingle among the rarest fifth and one of a text's;
   two similar texts always share one of these, so no link inside a class is left out either.

Links are decided by the shingles' 64-bit hashes, made once per candidate text. Measured against brute
force (tests): every class equal, also on a hub with spokes and a group pairwise just under 0.8.

Defined results: letters A-Z are lower-cased; a text of fewer words than a shingle is one shingle; null
and empty texts have no shingles and are one class; the class is that of all texts linked in a chain,
its id the smallest id that is not null (null if all are); repeated rows are in one class; an empty
table gives an empty result. `similar_documents` returns a row per row, `one_of_each` the first row of
each class (smallest id, null ids last, then the text's hash, then the other columns) with all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import chunks, texts
from .shared import cols, components, others, settle, settle_table, small_batches, text_hash
from .simhash import shingles

SHINGLE = 5
BANDS, ROWS = 40, 4
STEP = 4096
CHUNK = 1 << 20
SLICE, CELLS, FAMILY = 2048, 1 << 20, 1 << 14
COLUMNS = 4096
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)
_SALT = _RNG.integers(0, 2**64, BANDS, np.uint64)


def bands(words: list[bytes]) -> tuple[int, np.ndarray]:
    """How many different shingles, and the keys of their bands."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, set(words)), np.uint64, -1)
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), STEP):
        np.minimum(low, (x[i : i + STEP, None] * _MUL + _ADD).min(axis=0), out=low)
    pair = np.ascontiguousarray(low).view(np.uint64).reshape(BANDS, ROWS // 2)
    key = _SALT.copy()
    for j in range(ROWS // 2):
        key = (key ^ pair[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return len(h), key.view(np.int64)


def _banded(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", CHUNK):
            found = [bands(shingles(t, SHINGLE)) for t in texts(part, "t")]
            offsets = pa.array(np.arange(0, BANDS * len(found) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                part.column("s"), part.column("id"), pa.array([n for n, _ in found], pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k for _, k in found])))], names=["s", "id", "n", "bands"])

    return docs.mapInArrow(run, "s binary, id long, n int, bands array<long>")


def _similar(both: Column, n: Column, m: Column) -> Column:
    """Jaccard 0.8 or more, in whole numbers."""
    return both * 5 >= (n + m - both) * 4


def _lengths_allow(n: str, m: str) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, x) of the wanted texts: number, and hashes of the different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", CHUNK):
            x = [np.fromiter(map(xxhash.xxh3_64_intdigest, set(shingles(t, SHINGLE))), np.uint64, -1).view(np.int64) for t in texts(part, "t")]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(x, pa.list_(pa.int64()))], names=["k", "x"])

    once = docs.select("s", "t").join(wanted.select("s", "k"), "s").groupBy("k").agg(F.first("t").alias("t"))
    with small_batches(docs.sparkSession):
        return settle_table(once.mapInArrow(run, "k long, x array<long>"))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of text numbers that are similar."""
    told = pairs.join(sets.select(F.col("k").alias("a"), F.col("x").alias("xa")), "a").join(
        sets.select(F.col("k").alias("b"), F.col("x").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return told.filter(_similar(both, F.size("xa"), F.size("xb"))).select("a", "b")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (h, k, n) with the class each is in."""
    return members.join(links.withColumnRenamed("node", "k"), "k", "left").select("h", "k", "n", F.coalesce("root", "k").alias("root"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (h, k, n) of buckets with two texts or more, with each bucket's first text."""
    first = rows.groupBy("h").agg(F.min(F.struct("k", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("h", "lead")
    return settle(rows.join(first, "h").select("h", "k", "n", "lead"))


def _star(members: DataFrame) -> DataFrame:
    """Candidates (a, b): every text of a bucket and the bucket's first."""
    return members.filter("k <> lead.k").filter(_lengths_allow("n", "lead.n")).select(F.col("k").alias("a"), F.col("lead.k").alias("b"))


def _open(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two classes."""
    mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
    return placed.join(mixed, "h")


def _families(rows: DataFrame) -> DataFrame:
    """(key, k, n, root) of open rows: the family each text belongs to, or its buckets where that is too large."""
    lead = rows.groupBy("h").agg(F.min("k").alias("lead"))
    chained = components(rows.join(lead, "h").select(F.col("k").alias("a"), F.col("lead").alias("b")))
    named = settle(rows.select("k", "n", "root").distinct().join(chained.withColumnRenamed("node", "k").withColumnRenamed("root", "f"), "k", "left")
                   .select(F.coalesce("f", "k").alias("f"), "k", "n", "root"))
    size = named.groupBy("f").count()
    small = named.join(size.filter(F.col("count") <= FAMILY).select("f"), "f").select(F.struct(F.lit(0).alias("at"), F.col("f").alias("id")).alias("key"), "k", "n", "root")
    large = named.join(size.filter(F.col("count") > FAMILY).select("f"), "f").select("k")
    return small.unionByName(rows.join(large, "k").select(F.struct(F.lit(1).alias("at"), F.col("h").alias("id")).alias("key"), "k", "n", "root"))


def _cut(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Open classes as open buckets: each text in those of its n - ceil(0.8 n) + 1 shingles that the fewest texts of the class have.

    Two similar texts share one of them, as all shingles are in one order. Where the buckets would compare more
    pairs than the class has, the class itself is the bucket.
    """
    cells = rows.join(sets, "k").select("h", "k", "n", "root", F.explode_outer("x").alias("x"))
    cells = cells.withColumn("c", F.count("*").over(Window.partitionBy("h", "x")))
    cells = cells.withColumn("at", F.row_number().over(Window.partitionBy("h", "k").orderBy("c", "x"))).filter("at <= n div 5 + 1 and c > 1")
    met = settle_table(cells.select(F.col("h").alias("class"), F.xxhash64("h", "x").alias("h"), "k", "n", "root"))
    met = settle(_open(met))
    squares = F.sum(F.pow("count", F.lit(2))).alias("pairs")
    pairs = met.groupBy("class", "h").count().groupBy("class").agg(squares)
    whole = pairs.join(rows.groupBy(F.col("h").alias("class")).count(), "class").filter(F.col("pairs") > F.pow("count", F.lit(2))).select("class")
    classes = rows.withColumnRenamed("h", "class").join(whole, "class").withColumn("h", F.xxhash64("class"))
    return met.join(whole, "class", "left_anti").unionByName(classes).select("h", "k", "n", "root")


def _slices(texts: Column, n: Column) -> Column:
    """How many slices hold so many texts and shingles."""
    return F.greatest(F.ceil(texts / SLICE), F.ceil(n / CELLS)).cast("int")


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes in the families: outsiders, the texts not in the family's largest class, against all."""
    rows = settle(rows)
    per = rows.groupBy("key", "root").count()
    main = per.groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    rows = rows.join(main, "key").withColumn("out", F.col("root") != F.col("main"))
    outside = F.col("out").cast("int")
    size = rows.groupBy("key").agg(_slices(F.count("*"), F.sum("n")).alias("g"), _slices(F.sum(outside), F.sum(outside * F.col("n"))).alias("go"))
    dealt = rows.join(size, "key")
    # i: the slice of outsiders, j: the slice of the family; all texts meet each slice of outsiders
    j = F.pmod(F.xxhash64("k"), F.col("g")).cast("int")
    everyone = dealt.select("key", "k", F.explode(F.sequence(F.lit(0), F.col("go") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("lead"))
    mine = F.pmod(F.xxhash64("k", F.lit(7)), F.col("go")).cast("int")
    outsiders = dealt.filter("out").select("key", "k", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), F.lit(True).alias("lead"))
    return everyone.unionByName(outsiders).join(sets, "k").groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Counts of common hashes of every x with every y; hashes that only one set holds are left out first."""
    size = np.array([len(s) for s in (*x, *y)])
    values, code, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    ok = times[code] > 1
    row, col = np.repeat(np.arange(len(size)), size)[ok], shared[code[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(values) else 0, COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        block = np.zeros((len(size), COLUMNS), np.float32)
        block[row[a:b], col[a:b] - lo] = 1
        out += block[: len(x)] @ block[len(x) :].T
    return out.astype(np.int64)


def _forest(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links between the outsiders and the others of one pair of slices."""
    rows = rows.combine_chunks()
    lead = np.asarray(rows.column("lead"))
    sets = rows.column("x").combine_chunks()
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    held = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    x, y = np.flatnonzero(lead), np.flatnonzero(~lead)
    both = common([held[i] for i in x], [held[i] for i in y]) if len(x) and len(y) else np.zeros((len(x), len(y)), np.int64)
    size = np.diff(ends)
    near = 5 * both >= 4 * (size[x][:, None] + size[y][None, :] - both)
    k = rows.column("k").to_numpy()
    a, b = [], []
    new_x, new_y = np.ones(len(x), bool), np.ones(len(y), bool)
    for start in range(len(x)):
        todo = [(True, start)] if new_x[start] else []
        new_x[start] = False
        while todo:
            of_x, at = todo.pop()
            found = np.flatnonzero(near[at] & new_y if of_x else near[:, at] & new_x)
            (new_y if of_x else new_x)[found] = False
            a.append(np.full(len(found), k[(x if of_x else y)[at]]))
            b.append(k[(y if of_x else x)[found]])
            todo += [(not of_x, f) for f in found.tolist()]
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    return pa.table({"a": a[a != b], "b": b[a != b]})


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """(s, least, root) of every different text: its hash, its smallest id, and the number of its class.

    `linked` are pairs (s, first) of text hashes that something else found alike. Texts with one `first`, and it, are
    a class; all its pairs are held to the exact rule.
    """
    docs = docs.select(text_hash(text).alias("s"), F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    with small_batches(docs.sparkSession):
        nodes = settle(_banded(docs).groupBy("s").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                       .withColumn("k", F.monotonically_increasing_id()))
    every = nodes.select("k", "n", F.explode("bands").alias("h"))
    members = _shared(every)
    star, wanted = _star(members), members.select("k")
    if linked is not None:
        told = linked.select(F.col("first").alias("h"), F.explode(F.array("s", "first")).alias("s")).distinct()
        held = _shared(told.join(nodes.select("s", "k", "n"), "s").select("h", "k", "n"))
        star, wanted = star.unionByName(_star(held)), wanted.unionByName(held.select("k"))
    star = settle(star.distinct())
    sets = _sets(docs, nodes.join(wanted.distinct(), "k"))
    links = settle(_checked(star, sets))
    found = components(links)
    left = settle(_open(_rooted(members, found)))
    if linked is not None:
        classes = settle(_open(_rooted(held, found)))
        if not classes.isEmpty():
            left = settle(left.unionByName(_cut(classes, sets)))
    if not left.isEmpty():
        more = settle(_compared(_families(left), sets))
        if not more.isEmpty():
            found = components(settle_table(links.union(more)))
    return nodes.join(found.withColumnRenamed("node", "k"), "k", "left").select("s", "least", F.coalesce("root", "k").alias("root"))


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) of every document; the class id is the smallest id of its class."""
    classes = settle(near_copies(docs, id, text))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select(F.col("s").alias("_s"), "component_id")
    return docs.select(F.col(id), text_hash(text).alias("_s")).join(named, "_s").select(id, "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """The first document of each class, with all columns; only keys of what goes are sent to the documents."""
    classes = near_copies(docs, id, text, linked).select("s", "root")
    place = F.struct(F.col("i").isNull().alias("none"), F.col("i"), F.col("s"))
    rows = settle(docs.select(text_hash(text).alias("s"), F.col(id).alias("i")).groupBy("s", "i").agg(F.count("*").alias("times")).join(classes, "s"))
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    told = rows.join(first, "root").select("s", "i", "times", (place == F.col("first")).alias("stays"))
    keep = others(docs, "_s", "_i")
    keyed = docs.select(*cols(keep), text_hash(text).alias("_s"), F.col(id).alias("_i"))
    gone, twice = told.filter(~F.col("stays")), told.filter("stays and times > 1")
    same = lambda keys: (F.col("_s") == keys["s"]) & F.col("_i").eqNullSafe(keys["i"])
    left = keyed.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left.select(*cols(keep))
    # equal rows of one id: the smallest by the other columns
    again = left.join(twice, same(twice), "left_semi").groupBy("_s", "_i").agg(F.min(F.struct(*cols(keep))).alias("r")).select("r.*")
    return left.join(twice, same(twice), "left_anti").select(*cols(keep)).unionByName(again)
