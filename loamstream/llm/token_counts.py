"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer any context limit.

Each text is encoded whole, inside the task that reads it; only (length, documents) pairs leave the
task, combined before the shuffle. Running sums go over blocks of lengths first and inside a block
second, so no task holds the histogram: the one ordered step over blocks has one row per 1,024 lengths.

Defined results: a null text counts as empty (0 tokens); repeated rows count each time; special token
texts are ordinary text; an empty table gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import chunks
from .shared import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# white space as the pattern's \s sees it; runs too long for the pattern's look-ahead are encoded apart
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")
_held: dict = {}


def encoder(vocabulary: str, pattern: str):
    """The worker's encoder, loaded once per process from the file the driver sent."""
    if (vocabulary, pattern) not in _held:
        import tiktoken

        with open(SparkFiles.get(os.path.basename(vocabulary)), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _held[vocabulary, pattern] = tiktoken.Encoding(
            "corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _held[vocabulary, pattern]


def count_tokens(encoding, text: str) -> int:
    """Tokens of a text. The pattern takes a run of white space but for its last character as one piece."""
    n, at = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per document: n_tokens. The driver sends the vocabulary file, nodes need no copy of it."""
    docs.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary, pattern)
        for part in chunks(batches, "t", 4 << 20):
            sizes = [count_tokens(encoding, t) if t else 0 for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, **how) -> DataFrame:
    """(n_tokens, n_docs) over all documents."""
    return encoded_lengths(docs, **how).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Each length with the documents and tokens of it and above, below, and the corpus cut to it.

    `truncated_tokens` is the sum of min(length, n_tokens) over all documents. Between two lengths it
    grows by the documents above, so the table answers every limit exactly.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    hist = settle(hist)  # a row per length, read twice: without this all texts are encoded twice
    rows = hist.select("n_tokens", "n_docs", tokens.alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("_b"))
    blocks = rows.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "_b", F.coalesce(F.sum("_d").over(above), zero).alias("_da"), F.coalesce(F.sum("_t").over(above), zero).alias("_ta"),
        F.sum("_d").over(whole).alias("all_docs"), F.sum("_t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("_b").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, "_b").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("_da")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("_ta")).alias("tokens_from"),
    ).select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", "all_docs", "all_tokens",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(max_tokens, tokens): the corpus cut to each stated limit, exact for limits between lengths too."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "max_tokens long")
    # the smallest length at or above a limit has the same documents above the limit
    pairs = asked.join(sums, sums["n_tokens"] >= asked["max_tokens"], "left")
    best = pairs.groupBy("max_tokens").agg(F.min_by(F.struct("docs_from", "tokens_from", "all_tokens"), "n_tokens").alias("s"))
    total = sums.agg(F.max("all_tokens").alias("every"))
    return best.join(total).select("max_tokens", F.coalesce(
        F.col("s.all_tokens") - F.col("s.tokens_from") + F.col("max_tokens") * F.col("s.docs_from"),
        F.col("every"), F.lit(0)).cast("long").alias("tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    def least(q: float) -> Column:
        return F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens")))

    row = sums.agg(*[least(q).alias(f"q{i}") for i, q in enumerate(shares)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])).alias("r")).select("r.*")
