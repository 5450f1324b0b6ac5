"""Phrases of a corpus that stick together, per language, with exact counts.

Only the longest windows are counted: at every word of a piece the window of `max_words` words that begins there,
made by lead columns and padded where the piece ends. How often any shorter phrase occurs is then a sum over the
windows it begins, which a ROLLUP over the leading words of the counted windows gives for every length at once, down
to the words of a language. No text is read again and no n-grams of other lengths are made.

A task counts the windows of FLUSH words at a time before they travel, dealt by all words but the last. So windows with
the same beginning meet in one task. There the beginnings are summed, and then the windows of those that reach the least
count; the ROLLUP takes the prefixes shorter than that. However common a beginning is, it has a row per flush, not one per place.
Phrases under the least count can't be candidates or parts of one, so all that follows the counts is small and is read
from a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.llm.words import Words, byte_table, slices, text_arrays
from millrace.session import arrow_batches, checkpointed

# The bytes that end a piece, and those that part its words.
PIECE_END, BLANK = b".,;:!?\x0A\x0B\x0C\x0D", b" \t"

MAX_WORDS, LEAST, TOP = 3, 10, 2000
INSIDE_PERCENT = 50
UNKNOWN = "und"
# Words whose windows a task counts at once.
FLUSH = 1_000_000
# Rows of windows whose strings a task makes at once, and bytes of texts that Spark hands to it at once.
ROWS, BATCH_BYTES = 1 << 16, 4 << 20

_IN_WORD = byte_table(lambda b: b not in PIECE_END + BLANK)
_ENDS = byte_table(lambda b: b in PIECE_END)


def words_and_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(folded words, number of the piece of each, text of each): pieces have growing numbers."""
    w = Words(*text_arrays(column), _IN_WORD, lower=True)
    ends = np.cumsum(_ENDS[w.data], dtype=np.int64)
    size = w.stop - w.start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = w.data[w._word]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    # Both parts only grow, so their sum is the same for two words only where both are.
    return words, (ends[w.start] if len(w) else np.zeros(0, dtype=np.int64)) + w.doc, w.doc


def count_windows(words: pa.Array, piece: np.ndarray, group: np.ndarray, max_words: int, rows: int = ROWS):
    """Yields (group, begin, tail), `rows` rows at a time, of the distinct windows that start at the words, a row per group and
    beginning. begin: all words of a window but the last, joined by spaces. tail: three lines. The first has the words that follow,
    an empty one where the piece ends; the second how often each does, or nothing where each does once; the third the sum."""
    dictionary, code = words.dictionary, np.asarray(words.indices)
    wide = np.int64(len(dictionary) + 1)

    def lead(k: int) -> np.ndarray:
        word = np.zeros(len(code), dtype=np.int32)  # 0: no word of this piece stands there
        if k < len(code):
            np.add(code[k:], 1, out=word[: len(code) - k], where=piece[k:] == piece[: len(code) - k])
        return word

    def longer(number: np.ndarray, k: int) -> np.ndarray:
        key = np.multiply(number, wide, dtype=np.int64)
        key += lead(k)
        return key

    def firsts(key: np.ndarray) -> np.ndarray:
        """Where a sorted key is new."""
        new = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        return new

    # Number the beginnings of 0, 1, 2 ... words: places have one number where they agree so far. Groups number those of 0.
    number, at = group, np.zeros(0, dtype=np.int64)
    for k in range(max_words - 1):
        key = longer(number, k)
        order = np.argsort(key)
        new = firsts(key[order])
        number, at = np.empty(len(key), dtype=np.int32), order[new]
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        del key, order, new
    key = longer(number, max_words - 1)
    del number
    key.sort()
    place = np.flatnonzero(firsts(key))
    key, count = key[place], np.diff(place, append=len(key))
    leads = [lead(k)[at] for k in range(max_words - 1)]
    own = np.searchsorted(key // wide, np.arange(len(at) + 1))

    said = lambda codes: dictionary.take(pa.array(codes - 1, mask=codes == 0))
    space, line, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", "\n", ""))
    # Strings are made for some rows at a time.
    for first in range(0, len(at), rows):
        some = slice(first, first + rows)
        ends = own[first : first + rows + 1]
        held = slice(ends[0], ends[-1])
        offsets, times = pa.array(ends - ends[0], pa.int64()), count[held]
        joined = lambda values: pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), space)
        begin = pc.binary_join_element_wise(*(said(c[some]) for c in leads), space, null_handling="skip")
        total = np.add.reduceat(times, ends[:-1] - ends[0])
        lasts = joined(pc.fill_null(said(key[held] % wide), ""))
        counts = pc.if_else(pa.array(total == np.diff(ends)), nothing, joined(pa.array(times).cast(pa.large_string())))
        yield group[at[some]], begin, pc.binary_join_element_wise(lasts, counts, pa.array(total).cast(pa.large_string()), line)


def windows(docs: DataFrame, text: str, lang: str, max_words: int, flush: int = FLUSH) -> DataFrame:
    """lang, begin, tail: the windows of `max_words` words, counted by tasks and dealt by their beginning (`count_windows`)."""
    # Without nulls, or a join would filter them below the shuffle and have one of its own.
    schema = T.StructType([T.StructField(c, T.StringType(), False) for c in ("lang", "begin", "tail")])

    def run(batches):
        names: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def counted():
            words = pa.chunked_array([w for w, _, _ in held]).dictionary_encode().unify_dictionaries().combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            words = pa.DictionaryArray.from_arrays(words.indices, words.dictionary.cast(pa.large_string()))
            starts = np.cumsum([0, *(int(p[-1]) + 1 for _, p, _ in held)])
            piece = np.concatenate([p + s for (_, p, _), s in zip(held, starts)])
            group = np.concatenate([g for _, _, g in held])
            held.clear()
            known = pa.array(list(names), pa.string())
            for of, *columns in count_windows(words, piece, group, max_words):
                yield pa.RecordBatch.from_arrays([known.take(pa.array(of)), *(c.cast(pa.string()) for c in columns)], names=schema.names)

        for batch in batches:
            for part in slices(batch, 1):
                words, piece, doc = words_and_pieces(part.column(1))
                if not len(words):
                    continue
                of_text = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], dtype=np.int32)
                held.append((words, piece, of_text[doc]))
                size += len(words)
                if size >= flush:
                    yield from counted()
                    size = 0
        if held:
            yield from counted()

    met = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).mapInArrow(run, schema)
    return met.repartition("lang", "begin")


def _length(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, n: every phrase of 1 to `max_words` words found `least` times or more, and per language the
    empty phrase with `words` 0 and the number of all words."""
    # All three read every column of the dealt windows, so their plans agree up to the shuffle and it is made once.
    dealt = windows(docs, text, lang, max_words)
    summed = dealt.select("lang", "begin", F.substring_index("tail", "\n", -1).cast("long").alias("n"))
    begins = summed.groupBy("lang", "begin").agg(F.sum("n").alias("n"))
    # One condition on key and count together: on the key alone it would be moved below the shuffle.
    frequent = begins.filter(F.when(F.col("n") >= least, _length("begin")).otherwise(0) == max_words - 1).select("lang", "begin")

    # No window is more frequent than its beginning, so only those of frequent beginnings are taken apart, each with a part
    # that has no last word and stands for the beginning. Both sides are dealt alike, and of the windows a task reads at
    # least `least` make one beginning in the hashed side.
    held = dealt.join(frequent.hint("shuffle_hash"), ["lang", "begin"]).select("lang", "begin", F.split("tail", "\n").alias("line"))
    line = lambda k: F.split(F.col("line")[k], " ")
    parts = F.concat(F.arrays_zip(line(0).alias("last"), line(1).alias("n")), F.array(F.struct(F.lit(None).cast("string").alias("last"), F.col("line")[2].alias("n"))))
    each = held.select("lang", "begin", F.explode(parts).alias("x"))
    number = F.coalesce(F.nullif("x.n", F.lit("")).cast("long"), F.lit(1))
    longer = each.groupBy("lang", "begin", F.col("x.last").alias("last")).agg(F.sum(number).alias("n"))
    longer = longer.filter(F.when(F.col("last") == "", 0).otherwise(F.col("n")) >= least)
    words = F.when(F.col("last").isNull(), max_words - 1).otherwise(max_words)
    longer = longer.select("lang", F.concat_ws(" ", "begin", "last").alias("phrase"), words.alias("words"), "n")

    first = [f"w{k}" for k in range(1, max_words - 1)]
    # A window of fewer words has no prefix of k words; its rows count for the shorter prefixes only. Every window has a first word.
    prefix = lambda k: F.substring_index("begin", " ", k)
    prefixes = summed.select("lang", "n", *((prefix(k) if k == 1 else F.when(_length("begin") >= k, prefix(k))).alias(c) for k, c in enumerate(first, 1)))
    # Summed before the ROLLUP, which makes a row per level of each of its rows.
    rolled = prefixes.groupBy("lang", *first).agg(F.sum("n").alias("n")).rollup("lang", *first).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    # left_out has a bit per column that was summed over; the one row over all languages gets -1 words.
    words = F.lit(len(first)) - F.bit_count("left_out")
    shorter = rolled.select("lang", F.coalesce(*reversed(first), F.lit("")).alias("phrase"), words.alias("words"), "n")
    # Left are the rows whose prefix is as long as their level says.
    shorter = shorter.filter((F.col("words") == F.when(F.col("phrase") == "", 0).otherwise(_length("phrase"))) & ((F.col("n") >= least) | (F.col("words") == 0)) & F.col("lang").isNotNull())
    return longer.unionByName(shorter)


def _cut(phrase: str, k: int) -> tuple[Column, Column]:
    first = F.substring_index(phrase, " ", k)
    return first, F.substring(F.col(phrase), F.length(first) + 2, F.length(phrase))


def _scored(counts: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score of each candidate, by its lowest-scoring cut."""
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = F.array(*(F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), *(c.alias(n) for c, n in zip(_cut("phrase", k), ("first", "rest"))))) for k in range(1, max_words)))
    each = candidates.select("*", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    part = lambda name, n: counts.filter(f"words BETWEEN 1 AND {max_words - 1}").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = each.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # Exact: 10^6 a^2 stays below 10^38 up to 10^16 occurrences. a is at most l and r, so the quotient is at most 10^6.
    both = both.withColumns({"up": wide("a") * wide("a") * F.lit(1_000_000), "down": wide("l") * wide("r")})
    scored = both.select("lang", "phrase", "words", "a", F.struct(F.expr("up div down").alias("score"), "k", "l", "r").alias("best"))
    return scored.groupBy("lang", "phrase", "words", "a").agg(F.min("best").alias("best")).select("lang", "phrase", "words", "a", "best.score", "best.l", "best.r")


def _inside(counts: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, longer: the most occurrences of a longer candidate that holds the phrase."""
    split = counts.filter("words > 2").select("lang", "n", "words", F.split("phrase", " ").alias("w"))
    subs = [F.when(F.col("words") >= at + n, F.when(F.col("words") > n, F.array_join(F.slice("w", at + 1, n), " "))) for n in range(2, max_words) for at in range(max_words - n + 1)]
    if not subs:
        return counts.select("lang", "phrase", F.col("n").alias("longer")).limit(0)
    each = split.select("lang", "n", F.explode(F.filter(F.array(*subs), lambda x: x.isNotNull())).alias("phrase"))
    return each.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP,
                 inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of every language, by score.

    Texts are folded (A-Z), cut into pieces at punctuation and line ends, and those into words. A phrase of 2 to
    `max_words` words found `least` times (a) is a candidate; n counts the language's words. Each cut gives l and r, how
    often its two parts occur, and a score floor(10^6 a^2 / (l r)); the lowest counts, the shortest first part among
    equals. A candidate goes where a longer one that holds it occurs in `inside_percent` of its places or more.
    Ties rank by a, then by the phrase's bytes. A null language is `und`, a null or empty text has no words, repeated
    rows count each time, other columns aren't read, and an empty table gives no rows.
    """
    if max_words < 2 or least < 1:
        raise InvalidInput("phrases have two words or more and occur at least once")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        counts = checkpointed(phrase_counts(docs, text, lang, max_words, least))
    candidates = _scored(counts, max_words).join(_inside(counts, max_words), ["lang", "phrase"], "left")
    kept = candidates.filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
