"""Nearest vectors from a stored inverted file, word ranking by BM25, and the fusion of rankings.

Vectors are scaled to length one, so the dot product is the cosine. The inverted file gives every vector to the nearest of
some centroids and stores what is left to it in a byte per dimension. Centroids are learned from a bounded sample, the first
`sample` rows by a hash of their ids; every row is indexed. A search looks into the `probe` lists nearest to a query,
takes `refine` candidates by the coarse vectors and ranks those by the stored ones.

A list is cut into parts of about PART rows by a hash of the id, and the queries that probe it likewise, so one task meets two
bounded blocks however many copies a vector has and however many queries there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.session import checkpointed, partitions_for, stored as written

SAMPLE, ROUNDS, PART = 20_000, 12, 4096
MAX_LISTS = 4096
K1, B = 1.2, 0.75
FUSION = 60
# Queries, and words of them, that meet a part of the documents at once.
QUERIES, ASKED_WORDS = 512, 1 << 14
MAX_QUERIES = 10_000


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of length one; a null, an empty or a zero vector, or one of another length, is zeros."""
    out = np.zeros((len(column), dimensions), dtype=np.float32)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dimensions and None not in v:
            out[i] = v
    size = np.linalg.norm(out.astype(np.float64), axis=1)
    good = np.isfinite(size) & (size > 0)
    out[~good] = 0
    out[good] /= size[good, None].astype(np.float32)
    return out


def centroids(vectors: DataFrame, id_col: str, vector: str, lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids from a bounded sample; by default as many as the root of the rows, MAX_LISTS at most."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).filter("size(v) > 0")
    taken = rows.orderBy(F.xxhash64("i"), "i").limit(sample).select("v").toArrow()
    if not taken.num_rows:
        raise InvalidInput("there are no vectors to learn from")
    column = taken.column(0).combine_chunks()
    x = _matrix(column, max(len(v) for v in column.to_pylist()))
    wanted = lists or min(MAX_LISTS, math.isqrt(rows.count()) or 1)
    draw = np.random.default_rng(seed)
    # Copies would make equal centroids.
    distinct = np.unique(x, axis=0)
    centers = distinct[draw.permutation(len(distinct))[:wanted]]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers, dtype=np.float64)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centers).astype(np.float32)
    return centers


@dataclass(frozen=True)
class Index:
    path: str
    centers: np.ndarray
    id_type: T.DataType


def build(vectors: DataFrame, id_col: str, vector: str, path: str, **how) -> Index:
    """Write the inverted file at `path`, sorted by list: list, part, id, scale, code, and the vector itself. Rows without a
    usable vector stand in no list."""
    centers = centroids(vectors, id_col, vector, **how)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    schema = T.StructType([T.StructField("list", T.IntegerType()), source.schema["id"], T.StructField("scale", T.FloatType()), T.StructField("code", T.BinaryType()), source.schema["v"]])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), centers.shape[1])
            kept = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
            x = x[kept]
            near = np.argmax(x @ centers.T, axis=1) if len(kept) else np.zeros(0, dtype=np.int64)
            rest = x - centers[near]
            scale = np.abs(rest).max(axis=1, initial=0) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0).take(pa.array(kept)), pa.array(scale, pa.float32()),
                                              pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1).take(pa.array(kept))], names=schema.names)

    coded = checkpointed(source.mapInArrow(run, schema))
    parts = coded.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = coded.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt.repartitionByRange(partitions_for(dealt), "list", "part").sortWithinPartitions("list", "part").write.parquet(path)
    return Index(path, centers, source.schema["id"].dataType)


def search(queries: DataFrame, index: Index, id_col: str, vector: str, k: int = 10, probe: int = 8, refine: int = 50) -> DataFrame:
    """query, id, score, rank: the `k` nearest indexed vectors of each query, by cosine, ties by id.

    Queries without a usable vector find nothing. Query ids must be unique. `refine` candidates, k or more, are ranked by
    their whole vectors.
    """
    if not 1 <= k <= refine:
        raise InvalidInput("refine must be k or more, and k 1 or more")
    spark, centers = queries.sparkSession, index.centers
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector).cast("array<float>").alias("q"))
    probes = T.StructType([*asked.schema.fields, T.StructField("list", T.IntegerType())])

    def choose(batches):
        for batch in batches:
            x = _matrix(batch.column(1), centers.shape[1])
            kept = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
            n = min(probe, len(centers))
            lists = np.argsort(-(x[kept] @ centers.T), axis=1, kind="stable")[:, :n] if len(kept) else np.zeros((0, n), dtype=np.int64)
            rows = pa.array(np.repeat(kept, n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lists.ravel(), pa.int32())], names=probes.names)

    probed = checkpointed(asked.mapInArrow(choose, probes))
    stored = spark.read.parquet(index.path)
    # One row per list, MAX_LISTS at most unless more were asked for.
    parts = stored.select("list", "parts").distinct()
    blocks = probed.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("blocks"))
    left = probed.join(F.broadcast(parts), "list").join(F.broadcast(blocks), "list").select(
        "query", "q", "list", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    right = stored.select("list", "part", "id", "scale", "code").join(F.broadcast(blocks), "list").select(
        "list", "part", "id", "scale", "code", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    found = T.StructType([asked.schema["query"], T.StructField("id", index.id_type), T.StructField("near", T.FloatType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column("query").slice(0, 0), "id": b.column("id").slice(0, 0), "near": pa.array([], pa.float32())})
        q = _matrix(a.column("q").combine_chunks(), centers.shape[1])
        codes = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.int8).reshape(b.num_rows, -1)
        coarse = centers[a.column("list")[0].as_py()] + codes * np.asarray(b.column("scale"))[:, None]
        score = q @ coarse.T.astype(np.float32)
        n = min(refine, b.num_rows)
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        rows = np.repeat(np.arange(len(q)), n)
        return pa.table({"query": a.column("query").take(pa.array(rows)), "id": b.column("id").take(pa.array(best.ravel())), "near": pa.array(score[rows, best.ravel()], pa.float32())})

    keys = ["list", "part", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, found)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "id"))
    few = hits.withColumn("n", place).filter(F.col("n") <= refine).select("query", "id")
    whole = few.join(stored.select("id", "v"), "id").join(asked, "query")
    return ranked(whole.select("query", "id", cosine(F.col("q"), F.col("v")).alias("score")), k)


def exact(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str, k: int = 10) -> DataFrame:
    """What `search` would give if it compared every vector: a stated set of up to MAX_QUERIES queries against all rows, a block at a
    time. For measuring recall."""
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_vector).cast("array<float>").alias("q")).limit(MAX_QUERIES + 1).toArrow().combine_chunks()
    if asked.num_rows > MAX_QUERIES:
        raise InvalidInput(f"at most {MAX_QUERIES} queries are compared with all vectors")
    names = asked.column("query").combine_chunks()
    lengths = [len(v) for v in asked.column("q").to_pylist() if v]
    q = _matrix(asked.column("q").combine_chunks(), max(lengths, default=1)).astype(np.float64)
    usable = np.flatnonzero(np.abs(q).sum(axis=1) > 0)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    schema = T.StructType([queries.select(F.col(query_id).alias("query")).schema["query"], source.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), q.shape[1]).astype(np.float64)
            kept = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
            if not len(kept) or not len(usable):
                continue
            score = q[usable] @ x[kept].T
            n = min(k, len(kept))
            # Ids of equal scores decide at the cut, so all that equal the last one stay.
            last = np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
            rows, columns = np.nonzero(-score <= last)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(usable[rows])), batch.column(0).take(pa.array(kept[columns])), pa.array(score[rows, columns], pa.float64())], names=schema.names)

    return ranked(source.mapInArrow(run, schema), k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The first `k` ids of each query, by score and then by id, with their ranks. Rows beyond go before the shuffle."""
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: str, query_id: str, query_text: str, k: int = 10) -> DataFrame:
    """query, id, score, rank: the `k` documents that answer each query text best, by the words they share.

    Words are runs of letters, marks, digits and underscores, in lower case; a word that a query repeats counts once. The
    documents' words are counted before they meet the queries' words. Then parts of about PART documents meet blocks of queries, so
    a document's score for a query is a sum within one task, however common its words are, and only what may be among the
    first `k` of a part goes on. Scores are rounded to nine digits, so that copies tie and ids decide. Documents that share
    no word with a query aren't ranked for it.
    """
    lower, pattern = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}_]+")
    words = lambda c: F.regexp_extract_all(lower(c), pattern, F.lit(0))
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(words(query_text))).alias("word"))
    held = docs.select(F.col(id_col).alias("id"), words(text).alias("w"))
    totals = docs.agg(F.count("*").alias("docs"), F.avg(F.regexp_count(lower(text), pattern)).alias("mean")).first()
    number, mean = totals["docs"], totals["mean"] or 1.0
    # Written, so that Spark knows its size and doesn't shuffle all words to meet it.
    wanted = checkpointed(asked.select("word").distinct())
    counts = held.select("id", F.size("w").alias("length"), F.explode("w").alias("word")).join(wanted, "word").groupBy("id", "length", "word").agg(F.count("*").alias("tf"))
    counts = checkpointed(counts)
    weight = F.log(1 + (number - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarity = counts.groupBy("word").agg(F.count("*").alias("df")).select("word", weight.alias("idf"))
    weights, pairs = written(asked.join(rarity, "word").groupBy("query", "word").agg(F.sum("idf").alias("idf")))
    parts = -(-number // PART) or 1
    blocks = max(-(-pairs // ASKED_WORDS), -(-weights.select("query").distinct().count() // QUERIES), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weights.select("query", "word", "idf", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    right = counts.select("id", "length", "word", "tf", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    found = T.StructType([left.schema["query"], right.schema["id"], T.StructField("score", T.DoubleType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        coded = lambda t, c: t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        numbers = lambda t, c: np.asarray(t.column(c).combine_chunks())
        none = pa.table({"query": a.column("query").slice(0, 0), "id": b.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return none
        query, doc, word = coded(a, "query"), coded(b, "id"), coded(b, "word")
        which = np.asarray(pc.fill_null(pc.index_in(a.column("word").combine_chunks(), value_set=word.dictionary), -1))
        asks, idf = np.asarray(query.indices), numbers(a, "idf")
        tf, length, says = numbers(b, "tf"), numbers(b, "length").astype(np.int64), np.asarray(word.indices)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        # Texts with one id may differ in length; a word stands once in a text.
        texts, text_of = np.unique(np.asarray(doc.indices).astype(np.int64) * (length.max() + 1) + length, return_inverse=True)
        score = np.zeros((len(texts), len(query.dictionary)))
        by_word, by_ask = np.argsort(says, kind="stable"), np.argsort(which, kind="stable")
        rows = np.searchsorted(says[by_word], np.arange(len(word.dictionary) + 1))
        for some in np.split(by_ask, np.flatnonzero(np.diff(which[by_ask])) + 1):
            w = which[some[0]]
            if w >= 0:
                of = by_word[rows[w] : rows[w + 1]]
                score[np.ix_(text_of[of], asks[some])] += part[of, None] * idf[some]
        ids = texts // (length.max() + 1)
        if len(texts) > len(doc.dictionary):
            one = np.zeros((len(doc.dictionary), score.shape[1]))
            np.add.at(one, ids, score)
            score, ids = one, np.arange(len(one))
        # Rounding decides below, so what is near the last place stays.
        last = np.partition(score, -k, axis=0)[-k] - 1e-8 if k < len(score) else 0
        at, of = np.nonzero((score > 0) & (score >= last))
        return pa.table({"query": query.dictionary.take(pa.array(of)), "id": doc.dictionary.take(pa.array(ids[at])), "score": pa.array(score[at, of], pa.float64())})

    keys = ["part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, found)
    return ranked(met.withColumn("score", F.round("score", 9)), k)


def fused(rankings: list[DataFrame], k: int = 10, constant: int = FUSION) -> DataFrame:
    """One ranking of several (query, id, rank): each adds 1 / (constant + rank) to what it has found."""
    if not rankings:
        raise InvalidInput("there is nothing to fuse")
    each = rankings[0].select("query", "id", "rank")
    for other in rankings[1:]:
        each = each.unionByName(other.select("query", "id", "rank"))
    return ranked(each.groupBy("query", "id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), k)
