"""Elias-Fano sequences and files of arrays that are mapped into memory rather than read."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, end to end, in 64-bit words (and one to spare)."""
    words = np.zeros((len(values) * width >> 6) + 2, dtype=np.uint64)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        kept = values & np.uint64((1 << width) - 1)
        np.bitwise_or.at(words, word, kept << shift)
        over = (shift > 0) & (shift + np.uint64(width) > 64)
        np.bitwise_or.at(words, word[over] + 1, kept[over] >> (np.uint64(64) - shift[over]))
    return words


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the Elias-Fano form of non-decreasing `values` below `universe`."""
    values = values.astype(np.uint64)
    n = len(values)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros((n + (universe >> width) + 2) // 64 + 1, dtype=np.uint64)
    np.bitwise_or.at(bits, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1]
    return {"low": _pack(values, width), "high": bits, "ones": ones.astype(np.uint32 if n < 1 << 32 else np.uint64), "shape": np.array([n, width], dtype=np.int64)}


_M1, _M2, _M4 = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0F"))
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
# The place of the k-th one of a byte, at byte * 8 + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [7] * 8)[k] for b in range(256) for k in range(8)], dtype=np.uint64)


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.width = (int(x) for x in arrays["shape"])
        self._zeros = None

    def _select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high bits."""
        if bit:
            before = self.ones
        else:
            if self._zeros is None:
                self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
            before = self._zeros
        word = np.searchsorted(before, k.astype(before.dtype), side="right") - 1
        left = np.minimum((k - before.take(word).astype(np.int64)).astype(np.uint64), np.uint64(63))
        bits = self.high.take(word) if bit else ~self.high.take(word)
        # Ones of each byte and those before it, then the byte, then the place in it.
        ones = bits - (bits >> np.uint64(1) & _M1)
        ones = (ones & _M2) + (ones >> np.uint64(2) & _M2)
        ones = (ones + (ones >> np.uint64(4)) & _M4) * _EACH
        byte = np.bitwise_count((left * _EACH | _TOP) - ones & _TOP).astype(np.uint64) << np.uint64(3)
        byte = np.minimum(byte, np.uint64(56))
        left -= ones << np.uint64(8) >> byte & np.uint64(255)
        return word * 64 + (byte + _IN_BYTE[(bits >> byte & np.uint64(255)) << np.uint64(3) | left & np.uint64(7)]).astype(np.int64)

    def _next(self, bit: int, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one or zero, where that before it is at `place`."""
        word, within = place >> 6, (place & 63).astype(np.uint64)
        bits = self.high.take(word) if bit else ~self.high.take(word)
        bits = bits >> within >> np.uint64(1) << np.uint64(1) << within
        out = (word << 6) + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            out[far] = self._select(bit, k[far])
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # In two steps, since a shift by 64 is none.
        up = self.low.take(word + 1) << np.uint64(1) << (np.uint64(63) - shift)
        return (self.low.take(word) >> shift | up) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(1, i) - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        place = self._select(1, i)
        value = lambda at, k: ((at - k).astype(np.uint64) << np.uint64(self.width)) | self._lows(k)
        return value(place, i), value(self._next(1, place, i + 1), i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, within [begin, end) if given; -1 where it isn't there. The last value not above
        it is looked for among those with the same high bits."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        zero = self._select(0, np.maximum(high - 1, 0))
        at = np.where(high > 0, zero - (high - 1), 0)
        stop = np.where(high > 0, self._next(0, zero, high), zero) - high
        if begin is not None:
            at, stop = np.maximum(at, begin), np.minimum(stop, end)
        low = x & np.uint64((1 << self.width) - 1)
        # Values of the same high bits stand in the order of their low bits; dense runs make them many. One that is
        # alone is only compared.
        todo = np.flatnonzero(stop - at > 1)
        here, upto, wanted = at[todo], stop[todo], low[todo]
        while len(todo):
            middle = (here + upto) >> 1
            above = self._lows(middle) > wanted
            here, upto = np.where(above, here, middle), np.where(above, middle, upto)
            at[todo] = here
            left = np.flatnonzero(upto - here > 1)
            todo, here, upto, wanted = todo[left], here[left], upto[left], wanted[left]
        some = np.flatnonzero(at < stop)
        same = some[self._lows(at[some]) == low[some]]
        out[same] = at[same]
        return out


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def save(path: str, arrays: dict[str, np.ndarray]) -> int:
    """Write arrays to one file, whole or not at all; the same again after a lost executor. Its size."""
    fs, name = _place(path)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    fs.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    fs.move(part, name)
    return at


def drop(path: str) -> None:
    fs, name = _place(path)
    fs.delete_file(name)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views of its mapped pages. A file of a remote store is first copied to an unnamed
    file that goes with the process."""
    fs, name = _place(path)
    if isinstance(fs, pafs.LocalFileSystem):
        held = np.memmap(name, dtype=np.uint8, mode="r")
    else:
        copy = tempfile.TemporaryFile()
        with fs.open_input_stream(name) as source:
            while part := source.read(8 << 20):
                copy.write(part)
        copy.flush()
        held = np.memmap(copy, dtype=np.uint8, mode="r")
    size = int.from_bytes(held[:8].tobytes(), "little")
    head, at = json.loads(held[8 : 8 + size].tobytes()), 8 + size
    held = held.view(np.ndarray)  # which still maps, and costs less to index
    return {k: held[at + o : at + o + n * np.dtype(d).itemsize].view(d) for k, (d, n, o) in head.items()}
