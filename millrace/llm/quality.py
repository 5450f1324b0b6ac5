"""Quality rules: base counts of a text, and the Jensen-Shannon distance of its histograms to its language.

References are measured on all documents of a language: the histogram of character classes, and the shares of
its common words (at least COMMON_SHARE of its words). A text is held to what its language's reference is without
that text, and rejected where a histogram is further from it than a limit plus what a sample of its length strays
by chance; texts under a minimum length aren't judged by that histogram. A language with too few texts, or too few
words beside its longest text, is no reference: its texts are held to the nearest reference by characters alone,
as the words of another language say nothing of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.session import checkpointed
from millrace.llm.words import ALNUM, NOT_SPACE, Words, byte_table, covered, fresh, mix, per_text, text_arrays

COMMON_SHARE = 1 / 200
MIN_CHARS, MIN_WORDS = 200, 50
# What a language must hold to be a reference; words without those of its longest text.
REFERENCE_TEXTS, REFERENCE_WORDS = 10, 1000
# Distances run from 0 to 1.
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.35

# The characters that the base counts as symbols, and its limits.
SYMBOLS = b"#*$%&|<>"
BASE_MIN_WORDS, BASE_REPEAT_SHARE, REPEAT_WINDOW = 20, 30, 8

CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other", "wide"]


def _char_class(b: int) -> int:
    c = chr(b)
    if b >= 0xC0:
        return 7
    if b >= 0x80:
        return 8  # inside a character, not counted
    if c.isalpha():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 2
    if b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        return 3
    return 4 if c in ".,;:!?'\"()-" else 5 if b in SYMBOLS else 6


_CLASS = np.array([_char_class(b) for b in range(256)], dtype=np.int64)
_LINE = byte_table(lambda b: b != 0x0A)
_SYMBOL = byte_table(lambda b: b in SYMBOLS)
_LEAD = byte_table(lambda b: not 0x80 <= b < 0xC0)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [*(T.StructField(n, T.LongType()) for n in BASE), T.StructField("base_failed", T.BooleanType()),
          T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
          T.StructField("kept", T.BooleanType())]


def _byte_sums(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of entries whose key stands elsewhere in the same text, mask of those not the first of a key)."""
    order = np.argsort(mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets, NOT_SPACE)
    lines = Words(data, offsets, _LINE)
    solid = np.concatenate([[0], np.cumsum(NOT_SPACE[data], dtype=np.int64)])
    with_word = solid[lines.stop] > solid[lines.start]
    line_doc = lines.doc[with_word]
    _, later = _repeated(line_doc, lines.hash[with_word])
    at, keys = words.windows(REPEAT_WINDOW)
    twice, _ = _repeated(words.doc[at], keys)
    return [words.count, _byte_sums(NOT_SPACE[data] & _LEAD[data], offsets), _byte_sums(_SYMBOL[data], offsets),
            np.bincount(line_doc[later], minlength=words.docs), words.sums(covered(len(words), at[twice], REPEAT_WINDOW))]


def char_histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = len(CLASSES) + 1
    return np.bincount(doc * wide + _CLASS[data], minlength=(len(offsets) - 1) * wide).reshape(-1, wide)[:, :-1]


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of each row of counts and reference."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def strays(bins: int, n: np.ndarray) -> np.ndarray:
    """Divergence that a sample of `n` draws from the reference itself shows on average."""
    return (bins - 1) / (8 * np.log(2) * np.maximum(n, 1))


def _language_counts(docs: DataFrame, text: str, lang: str, count, fields: str) -> DataFrame:
    """Rows that `count(data, offsets)` makes of the texts of one language in a slice."""
    from millrace.llm.words import slices

    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                names = part.column(0).dictionary_encode()
                code = np.asarray(names.indices)
                for i, name in enumerate(names.dictionary.to_pylist()):
                    keys, counts = count(name, *text_arrays(part.column(1).filter(pa.array(code == i))))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["lang", "key", "n"])

    return source.mapInArrow(run, fields).groupBy("lang", "key").agg(F.when(F.col("key") == "most", F.max("n")).otherwise(F.sum("n")).alias("n"))


def _unique_words(data, offsets):
    words = Words(data, offsets, ALNUM, lower=True)
    _, at, n = np.unique(words.hash, return_index=True, return_counts=True)
    return words, at, n


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, dict[str, int], int, int, int]]:
    """Per language (null: ""): character class counts, exact counts of common words, numbers of words, of texts
    that have words, and of the longest text's words.

    A word with at least COMMON_SHARE of a language's words has at least half that share in enough slices that
    the counts of slices where it does add up to half its share. So at most 2 / COMMON_SHARE words a language
    are candidates, and their exact counts decide. Languages are few; one row each reaches the driver.
    """
    least = COMMON_SHARE / 2

    def first(name, data, offsets):
        words, at, n = _unique_words(data, offsets)
        often = n >= least * len(words)
        keys = [f"w{words.bytes(i).decode('utf-8', 'replace')}" for i in at[often]]
        classes = char_histogram(data, offsets).sum(axis=0)
        return [*keys, "n", "t", "most", *(f"c{i}" for i in range(len(classes)))], [*n[often].tolist(), len(words), np.count_nonzero(words.count), words.count.max(initial=0), *classes.tolist()]

    counted = checkpointed(_language_counts(docs, text, lang, first, "lang string, key string, n long"))
    total = counted.filter("key = 'n'").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    near = counted.join(total, counted.lang == total.of).filter((F.substring("key", 1, 1) != "w") | (F.col("n") >= least * F.col("total")))
    rows = near.select("lang", "key", "n").collect()
    wanted: dict[str, set[bytes]] = {}
    for r in rows:
        if r.key[0] == "w":
            wanted.setdefault(r.lang, set()).add(r.key[1:].encode())

    def second(name, data, offsets):
        words, at, n = _unique_words(data, offsets)
        mine = wanted.get(name, set())
        found = [(w.decode(), c) for i, c in zip(at.tolist(), n.tolist()) if (w := words.bytes(i)) in mine] if mine else []
        return [w for w, _ in found], [c for _, c in found]

    exact = _language_counts(docs, text, lang, second, "lang string, key string, n long").collect() if wanted else []
    out = {}
    for name in {r.lang for r in rows}:
        of = {r.key: r.n for r in rows if r.lang == name}
        classes = np.array([of.get(f"c{i}", 0) for i in range(len(CLASSES))], dtype=np.float64)
        common = {r.key: r.n for r in exact if r.lang == name and r.n >= COMMON_SHARE * of["n"]}
        out[name] = (classes, dict(sorted(common.items())), of["n"], of["t"], of["most"])
    return out


class _Judge:
    def __init__(self, known):
        self.names = sorted(known)
        self.chars = np.stack([known[n][0] for n in self.names]) if known else np.zeros((0, len(CLASSES)))
        vocabulary = sorted({w for n in self.names for w in known[n][1]})
        column = pa.array(vocabulary, pa.string())
        hashes = Words(*text_arrays(column), ALNUM, lower=True).hash
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
        self.words = np.zeros((len(self.names), len(vocabulary) + 1))
        self.common = np.zeros((len(self.names), len(vocabulary)), dtype=bool)
        for i, n in enumerate(self.names):
            for w, c in known[n][1].items():
                self.words[i, place[w]] = c
                self.common[i, place[w]] = True
            self.words[i, -1] = known[n][2] - self.words[i, :-1].sum()

    def __call__(self, column: pa.StructArray):
        data, offsets = text_arrays(column.field("text"))
        base = base_counts(data, offsets)
        failed = (base[0] < BASE_MIN_WORDS) | (100 * base[4] > BASE_REPEAT_SHARE * base[0])
        chars = char_histogram(data, offsets)
        words = Words(data, offsets, ALNUM, lower=True)
        found = np.zeros(len(words), dtype=np.int64) + len(self.hashes)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == words.hash, at, len(self.hashes))
        wide = len(self.hashes) + 1
        counts = np.bincount(words.doc * wide + found, minlength=words.docs * wide).reshape(-1, wide)
        n_chars, n_words = chars.sum(axis=1), counts.sum(axis=1)
        char_over, word_over = np.full(words.docs, np.inf), np.full(words.docs, np.inf)
        char_far, word_far = np.full(words.docs, np.nan), np.full(words.docs, np.nan)
        langs = column.field("lang").to_pylist()
        place = {n: i for i, n in enumerate(self.names)}
        named = np.array([bool(x) for x in langs], dtype=bool)
        own = np.array([place.get(x or "", -1) for x in langs], dtype=np.int64)
        for i, _ in enumerate(self.names):
            mine = np.flatnonzero((own == i) | (own == -1))  # a text without a reference of its own is held to the nearest
            inside = own[mine] == i
            mask = self.common[i]
            of = np.concatenate([counts[mine][:, :-1][:, mask], (n_words[mine] - counts[mine][:, :-1][:, mask].sum(axis=1))[:, None]], axis=1)
            reference = np.concatenate([self.words[i, :-1][mask], self.words[i, -1:]])
            a = js_distance(chars[mine], self.chars[i] - inside[:, None] * chars[mine])
            b = js_distance(of, reference - inside[:, None] * of)
            for far, over, d, limit, n, bins, told in ((char_far, char_over, a, CHAR_LIMIT, n_chars, len(CLASSES), True),
                                                       (word_far, word_over, b, WORD_LIMIT, n_words, len(reference), inside | ~named[mine])):
                beyond = d**2 - limit**2 - 3 * strays(bins, n[mine])
                nearer = (beyond < over[mine]) & told
                far[mine[nearer]], over[mine[nearer]] = d[nearer], beyond[nearer]
        rejected = ((n_chars >= MIN_CHARS) & (char_over > 0) & np.isfinite(char_over)) | ((n_words >= MIN_WORDS) & (word_over > 0) & np.isfinite(word_over))
        distance = lambda far: pa.array(far, mask=np.isnan(far))
        return [*(pa.array(b, pa.int64()) for b in base), pa.array(failed), distance(char_far), distance(word_far), pa.array(~failed & ~rejected)]


def judge(docs: DataFrame, name: str, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column `name`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance (null without a reference), kept.

    Null and empty texts have no words, so base_failed. A null or empty language is held to the nearest reference.
    Base counts compare texts with themselves only, so repeated rows change nothing but the references' counts: a
    row is left out of its reference, its copies aren't. Without any reference the base alone decides; an empty
    table gives an empty one.
    """
    known = {k: v for k, v in references(docs, text, lang).items() if v[2] - v[4] >= REFERENCE_WORDS and v[3] >= REFERENCE_TEXTS}
    own = {k: v for k, v in known.items() if k} or known
    kept = docs.columns if keep is None else keep
    both = fresh(docs, "judged")
    pair = F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))
    return per_text(docs.withColumn(both, pair), both, _Judge(own), FIELDS, name, keep=kept)
