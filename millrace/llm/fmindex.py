"""A compressed index of symbol sequences: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Many searches run in lock step as arrays of suffix ranges.
"""

from __future__ import annotations

import numpy as np

# Suffixes are sorted by this many symbols, which ranges of patterns shorter than it need.
SORTED = 64


class Bits:
    """A bit vector in 64-bit words with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class Index:
    """Of `text`, symbols from 1 up with a 0 after each sequence; no match crosses a 0."""

    def __init__(self, text: np.ndarray):
        rank = text.astype(np.int64)
        n, width = len(text), 1
        while width < SORTED:
            next_ = np.zeros(n, dtype=np.int64)
            next_[: n - width] = rank[width:] + 1 if n > width else 0
            # Ranks below 2^31 are enough for one shard.
            _, rank = np.unique(rank << 32 | next_, return_inverse=True)
            width *= 2
        self.suffix = np.argsort(rank, kind="stable").astype(np.int64)
        last = text[self.suffix - 1].astype(np.int64)
        self.sigma = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))]).astype(np.int64)
        self.levels: list[Bits] = []
        begin = np.zeros(self.sigma, dtype=np.int64)  # where each symbol's block begins in the last level
        symbols = np.arange(self.sigma)
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            level = Bits(ones.astype(np.uint8))
            self.levels.append(level)
            up = level.ones(begin)
            begin = np.where((symbols >> bit) & 1 == 1, level.zeros + up, begin - up)
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        self.begin = begin

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with `symbol` and go on as those of [low, high)."""
        for level, bit in zip(self.levels, range(len(self.levels) - 1, -1, -1)):
            a, b = level.ones(low), level.ones(high)
            right = (symbol >> bit) & 1 == 1
            low, high = np.where(right, level.zeros + a, low - a), np.where(right, level.zeros + b, high - b)
        base = self.first[symbol] - self.begin[symbol]
        return base + low, base + high


class LeastInRange:
    def __init__(self, values: np.ndarray):
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(values) - 2 * width + 1], last[width : len(values) - width + 1]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.rows[k][low[mine]], self.rows[k][high[mine] - (1 << k)])
        return out
