"""Source divergence audit: how far the word counts of two sources of a language lie apart.

1. Each task counts terms per (language, source) and sends every pair (group, term) once; sums follow.
   A term is kept in a language if at least `LEAST` of its documents hold it.
2. Kept terms are dealt to blocks by hash, so many that a block of any language has about `BLOCK` rows.
   In a block the terms are numbered in order, and a group's terms become one sorted array of
   (term id, count).
3. For each unordered pair of sources of a language and each block the two arrays are co-grouped. The
   shorter one is searched for in the longer one; numpy's search of sorted needles starts at the last
   hit, so it gallops. Shared and one-sided terms are priced both ways at once.
4. The blocks' sums are added up; terms that neither source holds all cost the same and are added by
   their number.

What a task holds is bounded by a block, whatever a language's vocabulary or a hot source. The result has one row per ordered pair
of sources, so that sorted arrays are sent once per pair they are in. All arithmetic is on whole
numbers; shares are divided in three steps of a thousand, exact up to 9e15 terms a language.

Defined results: null text, lang and source count as ''; a group without kept terms is still audited;
a language without kept terms gives 0 to each pair; a language with one source gives no pair; repeated
rows count as often as they occur, also as documents; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import chunks, fold_table, texts
from .shared import settle_table

LEAST = 3
TOP = 200
BLOCK = 1 << 18
FLUSH = 300_000
UNIT = 1_000_000_000
_FOLD = fold_table(digits=False)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term (UTF-8 bytes) in each group of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in seen.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()),
                    pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "d"])
            seen.clear()

        for part in chunks(batches, "text", 4 << 20):
            for lang, source, t in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts(part, "text"), strict=True):
                words = terms(t)
                n, d = seen[lang, source]
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > FLUSH:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, d long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """Rows of the kept terms with `ln`, the language's occurrences, and `lead`, 1 on one row of a (lang, term)."""
    one = Window.partitionBy("lang", "term")
    return (counts.withColumns({"df": F.sum("d").over(one), "ln": F.sum("n").over(one)}).filter(F.col("df") >= least)
            .withColumn("lead", (F.row_number().over(one.orderBy("source")) == 1).cast("int")).select("lang", "source", "term", "n", "ln", "lead"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * n / total) in longs: three steps of a thousand."""
    out, rest = F.lit(1).cast("long"), n
    for scale in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1000, total) * scale
        rest = (rest * 1000) % total
    return out


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _share(n: np.ndarray, total: int) -> np.ndarray:
    out, rest = np.ones(len(n), np.int64), n.astype(np.int64)
    for scale in (1_000_000, 1_000, 1):
        step, rest = np.divmod(rest * 1000, total)
        out += step * scale
    return out


def _price(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_all: int, b_all: int) -> tuple[int, int, int]:
    """Prices a against b and b against a over the terms of either, and the number of these terms.

    a and b are sorted (term ids, counts); a_all and b_all are the groups' totals plus the vocabulary.
    """
    if len(a[0]) > len(b[0]):
        back, forth, n = merge(b, a, b_all, a_all)
        return forth, back, n
    none = np.zeros(1, np.int64)
    p, q = _share(a[1] + 1, a_all), _share(b[1] + 1, b_all)
    p0, q0 = _share(none + 1, a_all), _share(none + 1, b_all)
    at = np.searchsorted(b[0], a[0])
    hit = at < len(b[0])
    hit[hit] = b[0][at[hit]] == a[0][hit]
    there = at[hit]
    alone = np.ones(len(b[0]), bool)
    alone[there] = False
    forth = _price(p[hit], q[there]) + _price(p[~hit], q0) + _price(p0, q[alone])
    back = _price(q[there], p[hit]) + _price(q0, p[~hit]) + _price(q[alone], p0)
    return forth, back, len(a[0]) + len(b[0]) - len(there)


def _arrays(kept: DataFrame, block: int) -> DataFrame:
    """(lang, block, source, ids, counts): each group's sorted array in each block of terms."""
    blocks = max(1, -(-kept.count() // block))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    at = Window.partitionBy("lang", "block").orderBy("term")
    pairs = F.sort_array(F.collect_list(F.struct("id", "n")))
    return dealt.withColumn("id", F.dense_rank().over(at)).groupBy("lang", "block", "source").agg(pairs.alias("x")).select(
        "lang", "block", "source", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))


def _merged(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of one pair; a side may be missing."""
    row = (left if left.num_rows else right).slice(0, 1)
    (a_all,), (b_all,) = row.column("a_all").to_pylist(), row.column("b_all").to_pylist()

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not t.num_rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return tuple(np.asarray(t.column(c).combine_chunks().flatten()) for c in ("ids", "counts"))

    forth, back, n = merge(side(left), side(right), a_all, b_all)
    return pa.table([*(row.column(c) for c in ("lang", "a", "b")), pa.array([forth]), pa.array([back]), pa.array([n])],
                    names=["lang", "a", "b", "forth", "back", "n"])


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP,
                  block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source, and the group's outstanding terms."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = settle_table(kept_terms(term_counts(docs), least))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("ln_all"), F.sum("lead").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("ln_all", F.lit(0)).alias("ln_all"),
        (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("all"))
    groups = settle_table(groups)

    p, q = share(F.col("n") + 1, F.col("all")), share(F.col("ln") + 1, F.col("ln_all") + F.col("v"))
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = priced.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    outstanding = found.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    a = groups.select("lang", "v", F.col("source").alias("a"), F.col("all").alias("a_all"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("all").alias("b_all"))
    pairs = settle_table(a.join(b, "lang").filter("a < b"))
    arrays = settle_table(_arrays(kept, block))
    keys = ("lang", "block", "a", "b")
    names = (*keys, "a_all", "b_all", "ids", "counts")
    left, right = (arrays.withColumnRenamed("source", s).join(pairs, ["lang", s]).select(*names).toDF(*names) for s in "ab")
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _merged, "lang string, a string, b string, forth long, back long, n long").groupBy("lang", "a", "b").agg(
        *(F.sum(c).alias(c) for c in ("forth", "back", "n")))
    one = F.lit(1).cast("long")
    absent = F.col("v") - F.coalesce("n", F.lit(0))
    p0, q0 = share(one, F.col("a_all")), share(one, F.col("b_all"))
    whole = pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b",
        F.when(F.col("v") > 0, F.coalesce("forth", F.lit(0)) + absent * price(p0, q0)).otherwise(0).alias("forth"),
        F.when(F.col("v") > 0, F.coalesce("back", F.lit(0)) + absent * price(q0, p0)).otherwise(0).alias("back"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("forth").alias("value")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value"))))
    apart = whole.select("lang", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "w.value")
    return apart.withColumn("rank", F.row_number().over(by_value)).unionByName(outstanding)
