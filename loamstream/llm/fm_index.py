"""FM-index over a sequence of small integers: suffix array, wavelet matrix, backward search, locate.

All steps are vectorised over many queries at once. The sequence is one shard of the corpus, so its
length is bounded by the shard's size and never by the corpus.
"""

from __future__ import annotations

import numpy as np

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(seq, kind="stable").astype(np.int64)
    s = seq[order]
    start = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(start)[np.cumsum(start) - 1]
    step = 1
    while True:
        # rank = first place of the suffix's group; groups of one are final
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, n))
        if size.max() == 1:
            return order
        slots = np.flatnonzero(np.repeat(size > 1, size))
        sub = order[slots]
        after = np.where(sub + step < n, rank[np.minimum(sub + step, n - 1)], -1)
        by = np.lexsort((after, rank[sub]))
        sub, after = sub[by], after[by]
        order[slots] = sub
        r = rank[sub]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (after[1:] != after[:-1])])
        start[slots] = new
        rank[sub] = slots[new][np.cumsum(new) - 1]
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane per symbol bit, byte-wise popcounts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.append(np.packbits(bit), np.uint8(0))
            ones = np.concatenate([[0], np.cumsum(_ONES[packed])]).astype(np.int64)
            self.planes.append((packed, ones, self.n - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        head = packed[i >> 3] & (0xFF00 >> (i & 7) & 0xFF).astype(np.uint8)
        return ones[i >> 3] + _ONES[head]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[q] occurs before place i[q]."""
        lo, hi = np.zeros_like(i), i
        for level, (packed, ones, zeros) in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            a, b = self._ones(packed, ones, lo), self._ones(packed, ones, hi)
            up = (symbol >> level & 1).astype(bool)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and its rank there, in one descent."""
        lo, hi, symbol = np.zeros_like(i), i, np.zeros_like(i)
        for packed, ones, zeros in self.planes:
            up = (packed[hi >> 3] >> (7 - (hi & 7)) & 1).astype(bool)
            a, b = self._ones(packed, ones, lo), self._ones(packed, ones, hi)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
            symbol = symbol << 1 | up
        return symbol, hi - lo


class FmIndex:
    """Index of a sequence of symbols >= 1 (0 is kept for the end mark)."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(seq.astype(np.int64), 0)
        self.n = len(seq)
        order = suffix_array(seq)
        bits = max(1, int(symbols - 1).bit_length())
        self.wavelet = WaveletMatrix(seq[order - 1], bits)  # the row of suffix 0 wraps to the end mark
        counts = np.bincount(seq, minlength=symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.sampled = order % self.SAMPLE == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [lo, hi) of each phrase (a row of equal-length symbols), last symbol first."""
        m, k = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(k - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            a = self.before[c] + self.wavelet.rank(c, lo[live])
            b = self.before[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start of the suffix at each row: step back with LF until a sampled row is met."""
        at, steps = rows.copy(), np.zeros_like(rows)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c, r = self.wavelet.access_rank(at[open_])
            at[open_] = self.before[c] + r
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.samples[self.sample_no[at]] + steps
