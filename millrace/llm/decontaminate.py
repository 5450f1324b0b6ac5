"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are runs of words of benchmark items. The search moves a cursor through a text's words. The last two
words under the cursor (the block) are looked up in a shift table: a block that stands in no pattern lets the
cursor jump past it, a block inside a pattern lets it jump to where it would line up. Only where the shift is
zero does the block's own hash choose a bucket of patterns, and each is compared word by word. Many texts
advance in lock step, as arrays of cursors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.llm.words import ALNUM, Words, fresh, mix, per_text, text_arrays

WINDOW = 13
# Benchmark text that one search carries to the executors; more text is searched in several rounds. The tables
# are arrays, some 35 times the text in memory.
ROUND_BYTES = 8 << 20
# Window starts that one cursor walks.
LANE = 512

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())),
          T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]


class Search:
    """Shift and bucket tables for patterns of one length: the runs of `size` words of `source` that begin at `at`, all different."""

    def __init__(self, source: Words, at: np.ndarray, size: int):
        self.size, self.hash = size, source.hash
        self.block = min(2, size)
        most = size - self.block + 1
        blocks = mix(self.hash[: len(self.hash) - self.block + 1] * np.uint64(3) + self.hash[self.block - 1 :])
        # Neighbouring patterns share their blocks, so there are about as many blocks as patterns.
        bits = max(12, int(np.ceil(np.log2(16 * max(1, len(at))))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, most, dtype=np.int16 if most < 1 << 15 else np.int64)
        for place in range(most):
            # Later places shift less, so the last write to a slot is the least.
            self.shift[blocks[at + place] & self.mask] = most - 1 - place
        ends = blocks[at + most - 1]
        self.order = np.argsort(ends, kind="stable")
        self.at = at[self.order]
        self.suffix, self.low = np.unique(ends[self.order], return_index=True)
        self.high = np.append(self.low[1:], len(at))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        n, h = self.size, words.hash
        starts = np.maximum(words.count - n + 1, 0)
        lanes = -(-starts // LANE)
        if not lanes.sum():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(words.docs), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cursor = words.first[of] + nth * LANE
        end = np.minimum(cursor + LANE, words.first[of] + starts[of])
        last = len(h) - self.block + 1
        block = mix(h[:last] * np.uint64(3) + h[self.block - 1 :])
        jump = self.shift[block & self.mask]
        aligned = []
        while len(cursor):
            step = jump[cursor + n - self.block]
            aligned.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            alive = cursor < end
            cursor, end = cursor[alive], end[alive]
        at = np.concatenate(aligned)
        key = block[at + n - self.block]
        bucket = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        known = self.suffix[bucket] == key
        at, bucket = at[known], bucket[known]
        width = self.high[bucket] - self.low[bucket]
        place = np.repeat(at, width)
        pattern = np.repeat(self.low[bucket] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        for k in range(n - 1, -1, -1):
            same = self.hash[self.at[pattern] + k] == h[place + k]
            place, pattern = place[same], pattern[same]
        return place, self.order[pattern]


class Patterns:
    """Windows of `window` words of every item; an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.words = source = Words(*text_arrays(pa.array([text for _, text in items], pa.string())), ALNUM, lower=True)
        item_of = np.array([number[item] for item, _ in items], dtype=np.int64)
        sizes = np.minimum(source.count, window)
        self.by_size = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            at, key = source.windows(size)
            mine = sizes[source.doc[at]] == size
            at, key = at[mine], key[mine]
            # Equal runs become one pattern. Runs that only share a hash stay patterns of their own.
            _, first, pattern = np.unique(key, return_index=True, return_inverse=True)
            other = np.zeros(len(at), dtype=bool)
            for k in range(size):
                other |= source.hash[at + k] != source.hash[at[first][pattern] + k]
            alone = np.flatnonzero(other)
            pattern[alone] = len(first) + np.arange(len(alone))
            of = np.unique(np.stack([pattern, item_of[source.doc[at]]]), axis=1)
            heads = at[np.concatenate([first, alone])]
            # The items of pattern i are those from bounds[i] to bounds[i + 1].
            self.by_size.append((Search(source, heads, size), heads, np.searchsorted(of[0], np.arange(len(heads) + 1)), of[1]))

    def __call__(self, column):
        words = Words(*text_arrays(column), ALNUM, lower=True)
        hits: list[dict[tuple[int, int], set[int]]] = [{} for _ in range(words.docs)]
        for search, heads, bounds, items in self.by_size:
            for at, pattern in zip(*(x.tolist() for x in search.find(words))):
                if words.run(at, search.size) == self.words.run(heads[pattern], search.size):
                    doc = int(words.doc[at])
                    hits[doc].setdefault((at - int(words.first[doc]), search.size), set()).update(items[bounds[pattern] : bounds[pattern + 1]].tolist())
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        merged = [_merge(sorted(h)) for h in hits]
        return [pa.array(words.count, pa.int64()), pa.array([[a for a, _ in m] for m in merged], kinds[0]),
                pa.array([[b - a for a, b in m] for m in merged], kinds[1]),
                pa.array([[self.names[i] for i in sorted(set().union(*h.values()))] for h in hits], kinds[2])]


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping (start, size) as ranges (start, stop) that do not overlap."""
    out: list[tuple[int, int]] = []
    for at, size in runs:
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + size))
        else:
            out.append((at, at + size))
    return out


def find_items(docs: DataFrame, items: DataFrame, name: str, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None,
               round_bytes: int = ROUND_BYTES) -> DataFrame:
    """`docs` with a struct column `name`: n_words; `at`, `size`: ranges of words inside occurrences of item
    windows; `items`: ids (as text) of the items that occur.

    Words: runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Null or empty texts have
    no words; items without words never occur; an item without id is listed as an empty text; repeated item rows
    count once. Items travel to the executors in rounds of at most `round_bytes` of text, so what is sent is
    bounded; a further round searches the documents again and adds its ranges.
    """
    if name in docs.columns:
        raise InvalidInput(f"column {name} exists already")
    small = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                         F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = small.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-2 * total // round_bytes)) if total > round_bytes else 1
    out, parts = docs, []
    kept = docs.columns if keep is None else keep
    for r in range(rounds):
        of_round = small if rounds == 1 else small.filter(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == r)
        patterns = Patterns([(x.item, x.text) for x in of_round.distinct().toLocalIterator()], window)
        held = docs.sparkSession.sparkContext.broadcast(patterns)
        part = fresh(out, f"{name}_{r}")
        parts.append(part)
        out = per_text(out, text, _Held(held), FIELDS, part, keep=[*dict.fromkeys([*kept, text]), *parts[:-1]] if r < rounds - 1 else [*kept, *parts[:-1]])
    both = F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"),
                    *(F.concat(*(F.col(f"{p}.{c}") for p in parts)).alias(c) for c in ("at", "size")),
                    F.array_distinct(F.concat(*(F.col(f"{p}.items") for p in parts))).alias("items"))
    return out.select(*kept, both.alias(name))


class _Held:
    def __init__(self, held):
        self.held = held

    def __call__(self, column):
        return self.held.value(column)


def hit_words(at, size):
    """Column: number of words inside any of the ranges (which overlap only between rounds)."""
    starts = F.array_sort(F.arrays_zip(at.alias("a"), size.alias("s")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    fold = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["a"] + x["s"] - F.greatest(acc["upto"], x["a"]))).alias("n"),
                                   F.greatest(acc["upto"], x["a"] + x["s"]).alias("upto"))
    return F.aggregate(starts, zero, fold, lambda acc: acc["n"]).cast("long")


def verdict(found: str):
    """Columns n_words, n_hit, n_items, items_sha256 and contaminated of a struct made by `find_items`.

    Contaminated: at least one word in twenty lies in an occurrence."""
    c = lambda field: F.col(f"{found}.{field}")
    n_hit = hit_words(c("at"), c("size"))
    return [c("n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(c("items")).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(c("items")), ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= c("n_words"))).alias("contaminated")]
