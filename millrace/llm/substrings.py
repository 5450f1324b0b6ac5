"""Removal of long passages that stand in an earlier document already, by FM-indexes over shards.

Equal windows of WINDOW words agree in every function of their words, so also in their minimizer: the least
hash of the GRAM-word runs inside. Consecutive windows with the same minimizer make a piece of a document. Only
pieces whose minimizer stands in several documents can hold a repeated window. Of those, equal pieces are one
content with an earliest document. Contents are sharded by minimizer; a shard's contents become an FM-index,
and all its contents stream through it by backward search: how far a window's words lead back while more than
one suffix is left is its matching statistic, and windows that reach their full length look up the earliest
document among the suffixes found. A minimizer with more than HOT contents is cut up further, into single
windows, of which equal ones are one content again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.fmindex import Index, LeastInRange
from millrace.llm.words import NOT_SPACE, Words, _STEP, covered, fresh, mix, per_text, powers, slices, text_arrays
from millrace.session import checkpointed, stored

WINDOW, GRAM = 50, 8
# Contents of one minimizer that one shard takes, and contents per shard.
HOT, SHARD = 20_000, 5_000

_PLACE_BITS = np.uint64(24)
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
          T.StructField("kept_sha256", T.StringType())]


def _least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` adjacent keys, the leftmost of equals."""
    place = np.arange(len(keys), dtype=np.uint64)
    low = (mix(keys) >> _PLACE_BITS << _PLACE_BITS) | (place & np.uint64((1 << 24) - 1))
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    begin = np.arange(len(low))
    return begin + ((low & np.uint64((1 << 24) - 1)).astype(np.int64) - begin) % (1 << 24)


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def pieces(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, words, hash of the minimizer, hash of the content) of every piece."""
    if len(words) < window:
        return pieces_of_none()
    h = words.hash
    last = len(h) - gram + 1
    runs = np.zeros(last, dtype=np.uint64)
    for k, p in enumerate(powers(gram)):
        runs += h[k : k + last] * p
    place = _least_places(runs, window - gram + 1)
    starts = len(h) - window + 1
    inside = words.doc[:starts] == words.doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return pieces_of_none()
    p = place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(at))
    begin, stop = at[first], at[end - 1] + window
    up = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    down = np.full(int(len(h)) + 1, _INVERSE, dtype=np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    content = mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    doc = words.doc[begin]
    return doc, begin - words.first[doc], stop - begin, mix(runs[p[first]]), content


def pieces_of_none() -> tuple[np.ndarray, ...]:
    empty = np.zeros(0, dtype=np.int64)
    return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)


def _tabled(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, mark (a hash of the text), at, n, mini, content of all pieces."""
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("mark", "at", "n", "mini", "content"))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                doc, at, n, mini, content = pieces(Words(*text_arrays(part.column(2)), NOT_SPACE), window, gram)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(at), pa.array(n), pa.array(mini.view(np.int64)), pa.array(content.view(np.int64))], names=schema.names)

    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def _earlier_windows(contents: list[tuple], window: int) -> list[tuple[list[int], list[int]]]:
    """For each (words, earliest document): (offsets, sizes) of its ranges of windows that stand in a content
    with an earlier document."""
    symbol: dict[str, int] = {}
    lists = [[symbol.setdefault(w, len(symbol) + 1) for w in words] for words, _ in contents]
    size = np.array([len(x) + 1 for x in lists])
    begin = np.cumsum(size) - size
    text = np.concatenate([np.array([*x, 0], dtype=np.int64) for x in lists])
    index = Index(text)
    order = {d: i for i, d in enumerate(sorted({d for _, d in contents}))}
    document = np.array([order[d] for _, d in contents])
    least = LeastInRange(np.repeat(document, size)[index.suffix])
    of = np.repeat(np.arange(len(lists)), np.maximum(size - window, 0))
    start = np.concatenate([b + np.arange(max(s - window, 0)) for b, s in zip(begin.tolist(), size.tolist())])
    active = np.arange(len(start))
    low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(text), dtype=np.int64)
    for back in range(window):
        low, high = index.step(low, high, text[start[active] + window - 1 - back])
        more = high - low > 1  # a single suffix is the window itself
        active, low, high = active[more], low[more], high[more]
    earlier = least(low, high) < document[of[active]] if len(active) else np.zeros(0, dtype=bool)
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in contents]
    for i in active[earlier].tolist():
        c, offset = int(of[i]), int(start[i] - begin[of[i]])
        offsets, sizes = out[c]
        if offsets and offset <= offsets[-1] + sizes[-1]:
            sizes[-1] = offset + window - offsets[-1]
        else:
            offsets.append(offset)
            sizes.append(window)
    return out


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (mini, content, at, n, id, mark, first) with the words of each content, from its first document."""
    by_doc = wanted.groupBy(F.col("first.i").alias("i"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("mini", "content", "at", "n", "first", "many")).alias("list"))
    # The lists of a document are no longer than the document; repeated rows give the same words.
    found = docs.join(by_doc, docs["id"].eqNullSafe(by_doc["i"]) & (docs["mark"] == by_doc["m"])).select("text", "list")
    inner = T.StructType([wanted.schema["mini"], wanted.schema["content"], wanted.schema["first"], wanted.schema["many"], T.StructField("words", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                words = Words(*text_arrays(part.column(0)), NOT_SPACE)
                lists = part.column(1)
                rows = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                at, n = np.asarray(rows.field("at")), np.asarray(rows.field("n"))
                texts = [words.run(int(words.first[d]) + a, k).decode() for d, a, k in zip(doc.tolist(), at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([rows.field(c) for c in ("mini", "content", "first", "many")] + [pa.array(texts, pa.string())], names=inner.names)

    return found.mapInArrow(run, inner).dropDuplicates(["mini", "content"])


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """id, mark, ranges: the ranges (at, n) of words of each document (id, mark, text) that lie in windows whose
    words also begin in a document with a smaller id. Rows without such a range are left out; a null id comes
    after all others."""
    all_pieces = _tabled(docs, window, gram)
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"))
    # Two ids, or one and a null, which is later. Written, so that the join can split a hot minimizer.
    several = checkpointed(all_pieces.groupBy("mini").agg(F.min("id").alias("l"), F.max("id").alias("h"), F.count("id").alias("c"), F.count("*").alias("n"))
                           .filter("l < h OR (c > 0 AND c < n)").select("mini"))
    shared = checkpointed(all_pieces.join(several, "mini", "left_semi"))
    contents = shared.groupBy("mini", "content").agg(F.min(order).alias("first"), F.min_by(F.struct("mark", "at", "n"), F.struct(order, "mark", "at")).alias("rep"))
    per_mini = contents.groupBy("mini").agg(F.count("*").alias("many"))
    contents, total = stored(contents.join(per_mini, "mini").select("mini", "content", "first", "rep.*", "many"))
    texts = checkpointed(_words_of(docs, contents.filter("many > 1")))
    shards = max(1, -(-total // shard))

    def search(table: pa.Table) -> pa.Table:
        rows = table.select(["mini", "content", "first", "words"]).to_pylist()
        rank = lambda first: (first["n"], () if first["i"] is None else (first["i"],))
        found = _earlier_windows([(r["words"].split(" "), rank(r["first"])) for r in rows], window)
        hit = [(r, f) for r, f in zip(rows, found) if f[0]]
        return pa.table({"mini": pa.array([r["mini"] for r, _ in hit], pa.int64()), "content": pa.array([r["content"] for r, _ in hit], pa.int64()),
                         "offset": pa.array([f[0] for _, f in hit], pa.list_(pa.int64())), "size": pa.array([f[1] for _, f in hit], pa.list_(pa.int64()))})

    flag_schema = "mini long, content long, offset array<long>, size array<long>"
    few = texts.filter(F.col("many") <= hot).withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards)))
    flagged = few.groupBy("shard").applyInArrow(search, flag_schema)
    ranges = flagged.select("mini", "content", F.explode(F.arrays_zip("offset", "size")).alias("z")).select("mini", "content", "z.offset", "z.size")

    # Hot minimizers: each window for itself; equal windows are brought together by their words.
    each = texts.filter(F.col("many") > hot).select("mini", "content", "first", F.split("words", " ").alias("w"))
    each = each.select("mini", "content", "first", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.struct(
        i.cast("long").alias("offset"), F.sha2(F.array_join(F.slice("w", i + 1, window), " "), 256).alias("key")))).alias("x")).select("mini", "content", "first", "x.*")
    first = each.groupBy("key").agg(F.min("first").alias("least"))
    single = each.join(first, "key").filter("least < first").select("mini", "content", "offset", F.lit(window).cast("long").alias("size"))
    ranges = checkpointed(ranges.unionByName(single))

    known = contents.select("mini", "content", "first")
    mine = shared.join(known, ["mini", "content"]).withColumn("me", order)
    whole = mine.filter("first < me").select("id", "mark", "at", "n")
    part = mine.filter("first = me").join(ranges, ["mini", "content"]).select("id", "mark", (F.col("at") + F.col("offset")).alias("at"), F.col("size").alias("n"))
    return whole.unionByName(part).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


class _Remove:
    def __call__(self, column: pa.StructArray):
        words = Words(*text_arrays(column.field("text")), NOT_SPACE)
        lists = column.field("ranges")
        size = np.diff(np.asarray(lists.offsets))
        rows = lists.flatten()
        doc = np.repeat(np.arange(words.docs), [s if v else 0 for s, v in zip(size.tolist(), lists.is_valid().to_pylist())])
        gone = covered(len(words), words.first[doc] + np.asarray(rows.field("at")), np.asarray(rows.field("n")))
        kept, data = [], words.data.tobytes()
        start, stop, left = words.start.tolist(), words.stop.tolist(), (~gone).tolist()
        for d in range(words.docs):
            a, b = int(words.first[d]), int(words.first[d + 1])
            kept.append(b" ".join([data[start[i] : stop[i]] for i in range(a, b) if left[i]]))
        return [pa.array(words.count, pa.int64()), pa.array(words.sums(gone), pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]


def remove_repeats(docs: DataFrame, name: str, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                   window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """`docs` with a struct column `name`: n_words, n_removed, kept (the words left, joined by one space) and its
    kept_sha256.

    Windows are judged on the input. Repeated rows and rows of one id are no earlier than each other; a null id
    comes last. Null texts and texts of fewer than `window` words lose nothing.
    """
    kept = docs.columns if keep is None else keep
    mark, ranges, both, of_id, of_mark = (fresh(docs, n) for n in ("mark", "ranges", "both", "of_id", "of_mark"))
    value = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(value).alias("mark"), value.alias("text"))
    found = repeated(slim, window, gram, hot, shard).select(F.col("id").alias(of_id), F.col("mark").alias(of_mark), F.col("ranges").alias(ranges))
    marked = docs.withColumn(mark, F.xxhash64(value))
    joined = marked.join(found, marked[id_col].eqNullSafe(found[of_id]) & (marked[mark] == found[of_mark]), "left")
    pair = F.struct(value.alias("text"), F.col(ranges).alias("ranges"))
    return per_text(joined.select(*kept, pair.alias(both)), both, _Remove(), FIELDS, name, keep=kept)
