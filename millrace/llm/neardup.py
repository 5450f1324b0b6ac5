"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is a weighted set of its runs of five words: weight (1 + ln tf) * idf. Document frequencies of all
documents stand in a count-min sketch of fixed size; idf is 1 up to COMMON of the documents and falls with the
logarithm to RARE_TO_COMMON for a shingle of every document, so a passage that many share counts for less and a
large group of copies is still told by it. Each of BANDS * ROWS consistent samples agrees between two texts
with the probability of their weighted Jaccard similarity; texts that agree on all samples of a band are
candidates, and the similarity itself decides.

Exact copies are one node from the start. In a bucket every node is held against two pivots first. Buckets that
still hold several components are narrowed by a further band, where nodes are closer to one another, and again
every node meets the pivots of its narrower buckets. At last the nodes of a bucket that are in different
components are compared by sketches of SKETCH_BITS bits, and by text where the sketches allow THRESHOLD, so no
link between classes is lost beyond what sampling misses (a few in 10^5 at the threshold itself); a large group
of copies is one component long before that, and costs a few comparisons a node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.llm.words import NOT_SPACE, Words, fresh, mix, per_text, slices, text_arrays
from millrace.operators.components import components
from millrace.session import checkpointed, stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
COMMON, RARE_TO_COMMON = 0.01, 0.85
# Offsets of the further bands that narrow an unsettled bucket, round by round.
REFINE = [(1, 2, 3, 4), (5, 6, 7, 8, 9, 10)]
# The sketch of document frequencies: DEPTH rows of WIDTH counters.
WIDTH, DEPTH, BLOCKS = 1 << 18, 2, 16

_SAMPLES = BANDS * ROWS
_RNG = np.random.default_rng(77)
# A pool of draws for the sampling; 16 bits of a shingle's hash choose one for each sample.
_R = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LNC = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _RNG.random(1 << 16, dtype=np.float32)
_UNIT = _LNC - _R * (1 - _BETA)  # the score of a shingle of weight 1
_KEYS = _RNG.integers(1, 1 << 63, _SAMPLES // 4, dtype=np.uint64)
# More samples, of which one bit each is kept, to tell pairs well below THRESHOLD without their texts.
_SKETCH_KEYS = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64)
SKETCH_BITS = 4 * len(_SKETCH_KEYS)
# A pair at THRESHOLD differs in a tenth of the bits; more than 4.5 standard deviations above that is further off.
SKETCH_MOST = int(SKETCH_BITS * ((1 - THRESHOLD) / 2 + 4.5 * (0.09 / SKETCH_BITS) ** 0.5))
_BAND_KEYS = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def node_of(text: Column) -> Column:
    """The exact text's identity (a null is an empty text)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, how often) of each text. Fewer than five words are one shingle."""
    words = Words(*text_arrays(column), NOT_SPACE, lower=True)
    at, keys = words.windows(SHINGLE)
    cut = np.searchsorted(words.doc[at], np.arange(words.docs + 1))
    out = []
    for d, n in enumerate(words.count.tolist()):
        if 0 < n < SHINGLE:
            h = words.hash[words.first[d] : words.first[d + 1]]
            out.append((mix(np.array([int(sum(int(x) * (i + 1) for i, x in enumerate(h))) % (1 << 64)], dtype=np.uint64) + np.uint64(n)), np.ones(1, dtype=np.int64)))
        else:
            out.append(np.unique(keys[cut[d] : cut[d + 1]], return_counts=True))
    return out


def _counters(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * d)) & np.uint64(WIDTH - 1)).astype(np.int64) + d * WIDTH for d in range(DEPTH)]


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The sketch: counters of how many documents hold a shingle, and the number of documents with words.

    Each task sends its counters in BLOCKS blocks; they are added in two steps, so what one task adds up grows
    with the square root of the number of tasks.
    """
    source = docs.select(F.col(text).alias("text"))
    size = WIDTH * DEPTH // BLOCKS
    salts = 32

    def count(batches):
        seen, n = np.zeros(WIDTH * DEPTH, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                held = [h for h, _ in shingles(part.column(0)) if len(h)]
                n += len(held)
                if held:
                    for c in _counters(np.concatenate(held)):
                        seen += np.bincount(c, minlength=len(seen))
        if n:
            from pyspark import TaskContext

            salt = TaskContext.get().partitionId() % salts
            blocks = [seen[i * size : (i + 1) * size] for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(BLOCKS), BLOCKS], pa.int32()), pa.array([salt] * (BLOCKS + 1), pa.int32()), pa.array([*(b.tobytes() for b in blocks), np.array([n]).tobytes()], pa.binary())], names=["block", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, counts binary"
    part = source.mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema)
    rows = {r.block: np.frombuffer(r.counts, dtype=np.int64) for r in part.groupBy("block").applyInArrow(add, schema).collect()}
    if not rows:
        return np.zeros(WIDTH * DEPTH + 1, dtype=np.int64)
    return np.concatenate([rows[i] for i in range(BLOCKS + 1)])


class Weights:
    """ln of the idf per counter, and from it the weights of a text's shingles."""

    def __init__(self, sketch: np.ndarray):
        share = sketch[:-1] / max(int(sketch[-1]), 1)
        fall = np.clip(np.log(np.maximum(share, COMMON) / COMMON) / np.log(1 / COMMON), 0, 1)
        self.idf = (1 - (1 - RARE_TO_COMMON) * fall).astype(np.float32)

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.maximum.reduce([self.idf[c] for c in _counters(h)]) if len(h) else np.zeros(0, dtype=np.float32)
        return idf * (1 + np.log(tf, dtype=np.float32)) if tf.size and tf.max() > 1 else idf


def samples(h: np.ndarray, weight: np.ndarray, keys: np.ndarray = _KEYS) -> np.ndarray:
    """Identities of the consistent samples of a weighted set, four for each key."""
    n = 4 * len(keys)
    best = np.full(n, np.inf, dtype=np.float32)
    chosen, level, every = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.float32), np.arange(n)
    step = max(1, (1 << 18) // n)
    for at in range(0, len(h), step):
        part, lnw = h[at : at + step], np.log(weight[at : at + step])
        x = (keys[:, None] ^ part[None, :]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC13FA9A902A6328F)
        x ^= x >> np.uint64(32)
        # One row per sample, so that the least score of a row is found in adjacent memory.
        draw = np.ascontiguousarray(x.view(np.uint16).reshape(len(keys), len(part), 4).transpose(2, 0, 1)).reshape(n, len(part))
        score, t = _UNIT[draw], None
        other = np.flatnonzero(lnw)
        if len(other):
            u, ln = draw[:, other], lnw[other]
            t = np.zeros(score.shape, dtype=np.float32)
            t[:, other] = np.floor(ln / _R[u] + _BETA[u])
            score[:, other] = _LNC[u] - _R[u] * (t[:, other] - _BETA[u] + 1)
        j = score.argmin(axis=1)
        least = score[every, j]
        better = least < best
        best = np.where(better, least, best)
        chosen = np.where(better, part[j], chosen)
        level = np.where(better, 0 if t is None else t[every, j], level)
    return mix(chosen + level.astype(np.int64).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + every.astype(np.uint64))


class _Sketches:
    def __init__(self, weights):
        self.weights = weights

    def __call__(self, column):
        bits = [samples(h, self.weights.value(h, tf), _SKETCH_KEYS) & np.uint64(1) for h, tf in shingles(column)]
        return [pa.array([np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits], pa.list_(pa.int64()))]


class _Signatures:
    def __init__(self, weights):
        self.weights = weights

    def __call__(self, column):
        bands, total = [], []
        for h, tf in shingles(column):
            if len(h):
                w = self.weights.value(h, tf)
                ids = samples(h, w).reshape(BANDS, ROWS)
                bands.append(mix((ids * _BAND_KEYS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                total.append(float(w.sum(dtype=np.float64)))
            else:
                bands.append(np.zeros(0, dtype=np.int64))
                total.append(0.0)
        return [pa.array(bands, pa.list_(pa.int64())), pa.array(total, pa.float64())]


def _similar(pairs: DataFrame, weights) -> DataFrame:
    """a, b of the pairs (a, b, text_a, text_b) whose weighted Jaccard similarity reaches THRESHOLD."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                both = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().dictionary_encode()
                profile = [(h, weights.value(h, tf)) for h, tf in shingles(both.dictionary)]
                code = np.asarray(both.indices)
                keep = []
                for i, j in zip(code[: part.num_rows].tolist(), code[part.num_rows :].tolist()):
                    (h, v), (g, w) = profile[i], profile[j]
                    _, x, y = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                    common = float(np.minimum(v[x], w[y]).sum(dtype=np.float64))
                    total = float(v.sum(dtype=np.float64) + w.sum(dtype=np.float64)) - common
                    keep.append(common > 0 and common >= (THRESHOLD - 1e-9) * total)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`id_col`, node, n_links, class_id: one row per row of `docs`.

    class_id is the smallest `id_col` of the row's class (null if none has one). A class holds exact copies
    (empty and null texts are copies of one another), and all texts linked, over any number of steps, by a
    weighted Jaccard similarity of at least 0.8; n_links counts the links that were verified at the row's text.
    Texts of one to four words are one shingle; texts without words are linked to none but their copies.
    `node` is the text's identity. Ties can't arise; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    weights = spark.sparkContext.broadcast(Weights(document_frequencies(slim, "text")))
    signed = per_text(slim.withColumn("node", node_of(F.col("text"))), "text", _Signatures(weights),
                      [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("weight", T.DoubleType())], "s", keep=["id", "node"])
    rows = checkpointed(signed.select("id", "node", "s.bands", "s.weight"))
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    spread = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high")
    members = checkpointed(spread.join(shared, ["band", "key"]))
    some = members.select("node").distinct()
    texts = checkpointed(slim.select(node_of(F.col("text")).alias("node"), "text").join(some, "node", "left_semi").dropDuplicates(["node"]))
    signatures = checkpointed(nodes.join(some, "node", "left_semi"))
    empty = spark.createDataFrame([], T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return stored(_similar(pairs.join(a, "a").join(b, "b"), weights))

    def labelled(links: DataFrame, n: int) -> DataFrame:
        if not n:
            return members.withColumn("label", F.col("node"))
        return members.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def unsettled(known: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        several = known.groupBy("band", "key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("band", "key")
        return checkpointed(known.join(several, ["band", "key"]).select("band", "key", "node", "label"))

    links, n = verified(_pairs(members.select("node", F.explode(F.array("low", "high")).alias("pivot"))))
    for offsets in REFINE:
        closer = unsettled(labelled(links, n)).join(signatures, "node").select("node", "label", "band", "key", F.explode(F.array(*(
            F.struct(F.lit(o).alias("offset"), F.element_at("bands", ((F.col("band") + o) % BANDS + 1).cast("int")).alias("more")) for o in offsets))).alias("x")).select("*", "x.*").drop("x")
        keys = ["band", "key", "offset", "more"]
        who = F.struct("node", "label")
        pivots = closer.groupBy(*keys).agg(F.min(who).alias("low"), F.max(who).alias("high")).filter("low.node != high.node")
        met = closer.join(pivots, keys).select("node", "label", F.explode(F.array("low", "high")).alias("p")).filter("label != p.label")
        found, m = verified(_pairs(met.select("node", F.col("p.node").alias("pivot"))))
        links, n = links.unionByName(found), n + m
    left = unsettled(labelled(links, n))
    sketched = per_text(texts.join(left.select("node").distinct(), "node", "left_semi"), "text", _Sketches(weights),
                        [T.StructField("bits", T.ArrayType(T.LongType()))], "s", keep=["node"])
    held = signatures.join(checkpointed(sketched.select("node", "s.bits")), "node")
    x = left.join(held, "node").select("band", "key", F.struct("node", "label", "weight", "bands", "bits").alias("x"))
    y = x.withColumnRenamed("x", "y")
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    first = F.aggregate(F.sequence(F.lit(0), F.lit(BANDS - 1)), F.lit(BANDS), lambda acc, i: F.when((acc == BANDS) & (F.element_at("x.bands", i + 1) == F.element_at("y.bands", i + 1)), i).otherwise(acc))
    met = x.join(y, ["band", "key"]).filter(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
        & (F.least("x.weight", "y.weight") >= (THRESHOLD - 1e-6) * F.greatest("x.weight", "y.weight"))
        & (differ <= SKETCH_MOST) & (first == F.col("band")))
    found, m = verified(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    links, n = links.unionByName(found), n + m
    if n:
        labels = components(links)
        links = links.distinct()
    else:
        links, labels = empty, empty.select(F.col("a").alias("node"), F.col("b").alias("label"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = checkpointed(rows.select("id", "node").join(labels.join(degree, "node", "left"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = named.groupBy("label").agg(F.min("id").alias("class_id"))
    return named.join(least, "label").select(F.col("id").alias(id_col), "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_id")


def _pairs(held: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of a table (node, pivot)."""
    return held.filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def survivors(docs: DataFrame, classes: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, one per class: that of the smallest id (nulls last); between rows of one id, that of
    the smallest text identity, once."""
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("node").alias("t"))
    # Rows of one class share class_id, but rows without any id don't share one; the node stands in for it.
    chosen = classes.withColumn("c", F.coalesce(F.col("class_id").cast("string"), F.hex("node"))).groupBy("c").agg(F.min(order).alias("k")).select("k.i", "k.t")
    node = fresh(docs, "node")
    marked = docs.withColumn(node, node_of(F.col(text)))
    kept = marked.join(chosen, marked[id_col].eqNullSafe(chosen["i"]) & (marked[node] == chosen["t"]), "left_semi")
    return kept.dropDuplicates([id_col, node]).drop(node)
