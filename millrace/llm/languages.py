"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ORDER bytes: how often each byte followed each context in its
training texts. A byte is coded in the longest known context; if it never followed there, an escape is coded
and the next shorter context tried, down to equal chances of all bytes. With the counts frozen, a byte's code
length depends on it and the ORDER bytes before it, so trees become sorted lists: of each order's runs with their
code lengths, and of its contexts with their escapes. A run that isn't listed walks down its suffixes. The
language that codes a text in the fewest bits is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.llm.words import LOWER, byte_table, per_text, slices, text_arrays

ORDER = 3
# Training text per language. Statistics of a few bytes settle long before; the bound is on the sample only.
TRAIN_BYTES = 600_000
UNKNOWN = "und"

# A row's draw has three digits of so many bits.
_DIGIT_BITS = 10
# Symbols: 0 for the start of a text, and one for each byte.
_BITS = 9
_LETTER = byte_table(lambda b: chr(b).isalpha() and b < 0x80)

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of bytes with ORDER starts before each text, the place of every byte in it)."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + ORDER * (doc + 1)
    out = np.zeros(len(data) + ORDER * (len(offsets) - 1), dtype=np.int64)
    out[at] = data
    out[at] += 1
    return out, at


def _runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The run of ORDER + 1 symbols that ends with each byte, its last one lowest."""
    held, at = _padded(LOWER[data], offsets)
    return sum(held[at - k] << (_BITS * k) for k in range(ORDER + 1)) if len(at) else np.zeros(0, dtype=np.int64)


def grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, code, n: how often each run of ORDER + 1 symbols (A-Z lower-cased; starts before a text) occurs."""
    source = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                names = part.column(0).dictionary_encode()
                code = np.asarray(names.indices)
                for i, name in enumerate(names.dictionary.to_pylist()):
                    data, offsets = text_arrays(part.column(1).filter(pa.array(code == i)))
                    keys, n = np.unique(_runs(data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    return source.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class _Level:
    """One order of a language's tree: known runs and their code lengths, known contexts and their escapes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, order: int):
        self.mask = (1 << _BITS * (order + 1)) - 1
        self.runs, inverse = np.unique(codes & self.mask, return_inverse=True)
        count = np.bincount(inverse, weights=n, minlength=len(self.runs))
        self.contexts, row = np.unique(self.runs >> _BITS, return_inverse=True)
        total, kinds = np.bincount(row, weights=count), np.bincount(row)
        self.lengths = np.log2((total + kinds)[row] / count)
        self.escapes = np.log2((total + kinds) / kinds)


def _find(listed: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a sorted list."""
    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
    return at, listed[at] == keys


class Trees:
    """Context trees of all languages; their lists are made where they are used."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counted)
        self.counts = [counted[n] for n in self.names]
        self.levels = None

    def lists(self) -> list[list[_Level]]:
        """The levels of every language, the longest contexts first."""
        if self.levels is None:
            self.levels = [[_Level(*c, order) for order in range(ORDER, -1, -1)] for c in self.counts]
        return self.levels

    @staticmethod
    def _lengths(levels: list[_Level], codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run, by its longest known suffix."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for level in levels:
            keys = codes[todo] & level.mask
            at, known = _find(level.runs, keys)
            out[todo[known]] += level.lengths[at[known]]
            todo, keys = todo[~known], keys[~known]
            at, known = _find(level.contexts, keys >> _BITS)
            out[todo[known]] += level.escapes[at[known]]
        out[todo] += 8  # bits of a byte by equal chances
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            codes, inverse = np.unique(_runs(data, offsets), return_inverse=True)
            for i, levels in enumerate(self.lists()):
                out[some, i] = np.add.reduceat(self._lengths(levels, codes)[inverse], offsets[some])
        return out


class _Predict:
    def __init__(self, trees):
        self.trees = trees

    def __call__(self, column):
        trees = self.trees.value
        data, offsets = text_arrays(column)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
            has[i] = any(c.isalpha() for c in column[i].as_py() or "")
        if not trees.names:
            has[:] = False
            return [pa.array([UNKNOWN] * len(has)), pa.array(np.zeros(len(has)))]
        bits = trees.bits(data, offsets)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [pa.array([trees.names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], pa.string()), pa.array(np.where(has, score, 0.0))]


def _by_name(values: dict[str, int], name: Column) -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))[name]


def _last_draws(rows: DataFrame, name: Column, draw: Column, size: Column, upto: int) -> dict[str, int]:
    """The draw of each name up to which its rows hold `upto` bytes, that of the row which reaches it included.

    Bytes are summed by the first digit of the draw; where the limit lies inside a digit of several rows, these
    are summed by the next one. Only sums reach the driver.
    """
    last, within = {}, {}
    for digit in (2, 1, 0):
        bits = _DIGIT_BITS * digit
        part = F.shiftright(draw, bits)
        if digit < 2:
            rows = rows.filter(F.shiftright(draw, bits + _DIGIT_BITS) == _by_name({l: p for l, (p, _) in within.items()}, name))
        sums = rows.groupBy(name.alias("l"), part.alias("part")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).collect()
        running, within = {l: before for l, (_, before) in within.items()}, {}
        reached = set()
        for r in sorted(sums, key=lambda r: (r["l"], r["part"])):
            l = r["l"]
            if l in reached:
                continue
            before = running.get(l, 0)
            running[l] = before + r["n"]
            last[l] = (r["part"] + 1 << bits) - 1
            if running[l] >= upto:
                reached.add(l)
                if digit and r["rows"] > 1:
                    within[l] = r["part"], before
        if not within:
            break
    return last


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_bytes: int = TRAIN_BYTES) -> Trees:
    """Context trees of the languages of `docs`, whose rows all count as labelled (null languages are left out).

    Each language gives its rows in the order of a hash until they hold `train_bytes`, the first one whatever its
    size, so that none with text is left without a tree. Repeated rows count each. What reaches the driver is
    bounded by `train_bytes`, the languages and their longest rows.
    """
    named = docs.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    name, draw = F.col(lang).cast("string"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 3 * _DIGIT_BITS))
    last = _last_draws(named, name, draw, F.octet_length(text), train_bytes)
    if not last:
        return Trees({})
    rows = grams(named.filter(draw <= _by_name(last, name)), text, lang).toArrow()
    names = np.array(rows.column("lang").to_pylist(), dtype=object)
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    return Trees({l: (codes[names == l], n[names == l]) for l in last})


def predict(docs: DataFrame, trees: Trees, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column `name`: lang_pred, and score, the probability of that language if all were
    equally likely before. Null texts and texts without a letter, and all if nothing was learned: `und`, 0."""
    return per_text(docs, text, _Predict(docs.sparkSession.sparkContext.broadcast(trees)), FIELDS, name, keep=keep)


def held_out(key: Column, parts: int) -> Column:
    """Whether crc32 of the key as text (a null: an empty text) leaves 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == 1
