"""Keyed permutations of the numbers below n: a Feistel network on their bits, walked until it lands below n."""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 8


def permute(x: int, n: int, key: bytes, allowed=None) -> int:
    """Where the permutation of `key` sends `x` (0 <= x < n). With `allowed`, it permutes the numbers that
    `allowed` accepts among themselves; `x` must be one of them."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            size = -(-half // 8)
            digest = hashlib.blake2b(bytes([r]) + right.to_bytes(size, "big"), key=key, digest_size=min(64, size + 8)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        x = left << half | right
        if x < n and (allowed is None or allowed(x)):
            return x


def permute_all(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The same idea for arrays, with arithmetic rounds: spreads, doesn't hide. 0 <= x < n <= 2^62."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            y = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((y ^ (y >> np.uint64(32))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)
