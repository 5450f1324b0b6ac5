"""Words of whole texts as arrays: where they lie, which document they belong to, and a 64-bit hash of each.

Texts stay in the UTF-8 bytes that Arrow hands over. All steps are array operations over slices of a few MB,
so memory does not depend on the number or length of the documents beyond the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from millrace.errors import InvalidInput

# Bytes of text worked on at a time.
SLICE_BYTES = 2 << 20

# The byte classes that the definitions of a word name. White space: space, tab to carriage return.
SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


NOT_SPACE = byte_table(lambda b: b not in SPACE)
# Digits, lower-case letters, and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BYTE_KEYS = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers never vanish and have inverses
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
# Words hashed at a time, so that their bytes' terms stay in the processor's cache.
_PART = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts. `start`, `stop`: byte ranges in `data`; `doc`: index of the text; `first`: index of
    each text's first word, with the total at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False):
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        self.docs = len(offsets) - 1
        word = inside[self.data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(word))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)
        self._word = word
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = np.empty(len(self), dtype=np.uint64)
            cut = [*range(0, len(self), _PART), len(self)]
            spans = [slice(int(self.start[a]), int(self.stop[b - 1])) for a, b in zip(cut, cut[1:])]
            most = max((s.stop - s.start for s in spans), default=0)
            up, back = powers(most), powers(most, _BACK)
            for a, b, span in zip(cut, cut[1:], spans):
                # Sums over all bytes, a power of the place each; a word's own is then brought back to its start.
                start, last = self.start[a:b] - span.start, self.stop[a:b] - (span.start + 1)
                terms = _BYTE_KEYS[self.data[span]] * up[: span.stop - span.start]
                total = np.cumsum(terms)
                self._hash[a:b] = mix((total[last] - total[start] + terms[start]) * back[start] + (last - start + 1).astype(np.uint64))
        return self._hash

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()

    def run(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by one space."""
        return b" ".join(self.bytes(k) for k in range(i, i + n))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of `n` words inside one text."""
        if len(self) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        last = len(self) - n + 1
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        total = np.zeros(last, dtype=np.uint64)
        for k, p in enumerate(powers(n)):
            total += self.hash[k : k + last] * p
        return at, mix(total[at] + np.uint64(n))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per text of a value per word."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def covered(length: int, at: np.ndarray, size) -> np.ndarray:
    """Which of `length` places lie in any range that begins at `at` and holds `size` places."""
    change = np.zeros(length + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, index: int, limit: int = SLICE_BYTES):
    """Cut a batch so that the texts of column `index` (or of its field `text`) stay near `limit` bytes; one
    text is never cut."""
    column = batch.column(index)
    _, offsets = text_arrays(column.field("text") if pa.types.is_struct(column.type) else column)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def per_text(df: DataFrame, text: str, compute, fields: list[T.StructField], name: str, keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """The columns `keep` of `df` (all if None) and one struct column `name` of what `compute` says of each text.

    `compute(column)` gets a slice of the text column and returns one array per field. `name` must be new.
    """
    kept = df.columns if keep is None else keep
    if name.lower() in {c.lower() for c in kept}:
        raise InvalidInput(f"there is a column {name} already")
    source = df.select(*dict.fromkeys([*kept, text]))
    index = source.columns.index(text)
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(name, T.StructType(fields))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, index, limit):
                made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in compute(part.column(index))]
                struct = pa.StructArray.from_arrays(made, names=[f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), struct], names=[*kept, name])

    places = [source.columns.index(c) for c in kept]
    return source.mapInArrow(run, schema)
