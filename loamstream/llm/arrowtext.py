"""Shared helpers of the Arrow-based operators: bounded chunks, word lists, appended result columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import cols, others

CHUNK_BYTES = 16 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row where a text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered for frequent words; emptied when it holds too many."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def append_struct(df: DataFrame, name: str, fields: T.StructType, fn, sized_by: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """All columns of df and one struct column that `fn(batch) -> pa.Array` makes; a clash is replaced."""
    df = df.select(*cols(others(df, name)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, sized_by, limit):
            yield pa.RecordBatch.from_arrays([*part.columns, fn(part)], names=[*part.schema.names, name])

    return df.mapInArrow(run, schema)


def fold_table(digits: bool) -> bytes:
    """For bytes.translate: A-Z lower-cased, a-z, bytes beyond ASCII and, if asked, digits kept, all else a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or digits and 48 <= c <= 57 else 32 for c in range(256))
