"""Mixing sources to target weights, in words.

The words of a source, its documents in a fixed shuffled order, are packed into blocks of BLOCK words. The
output is dealt in shards. How many blocks each source gives a shard is a multinomial draw, conditioned on the
sources' totals: the shards form a binary tree, and each node splits the counts it holds between its halves by
a multivariate hypergeometric draw seeded by the node. So a shard finds its counts, and where they begin in
each source, in log2(shards) steps without hearing of other shards. Slot i of a source is sent through the
source's pseudorandom permutation of its block numbers (another one each time through), and blocks join their
slots by source and number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.llm.permute import permute_all
from millrace.llm.words import fresh
from millrace.session import checkpointed

BLOCK = 64
# Blocks of a shard of the output.
SHARD = 8192
SEED = 11

WORD = r"[^\x20\x09-\x0D]+"

# Names of the mix's own columns. A document column of such a name gets underscores behind it until it is free.
OWN = frozenset("shard slot epoch block from_word n_words words size source_size target taken _source_no _offset _size _words _cut no name n".split())


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """What each source should give: `share` of all sizes by weight, at most `most` times its size; what is
    above that is shared again by weight among the others until none is above."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        if not over:
            return [left * weights[i] / total if i in open_ else x for i, x in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


class Mix:
    """What `plan` found out: `packed` (document columns, source_no, offset, size), per source its name,
    size, target, number of blocks and how many of them are dealt, and which columns were renamed."""

    def __init__(self, packed: DataFrame, names: list, sizes: list[int], goal: list[float], seed: int, renamed: dict[str, str]):
        self.packed, self.names, self.sizes, self.goal, self.seed, self.renamed = packed, names, sizes, goal, seed, renamed
        self.blocks = [-(-s // BLOCK) for s in sizes]
        self.dealt = [round(t * b / s) if s else 0 for t, b, s in zip(goal, self.blocks, sizes)]


def split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `counts` items of each kind fall among `left` places dealt at random."""
    total = int(counts.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):  # beyond the library's range the normal law is exact to a part in 10^4
        rest = total - c
        mean = left * c / total if total else 0
        spread = math.sqrt(max(0.0, mean * rest / max(total, 1) * (total - left) / max(total - 1, 1)))
        out[i] = min(max(round(rng.normal(mean, spread)), left - rest, 0), c, left)
        left, total = left - int(out[i]), rest
    return out


def shard_counts(dealt: list[int], shard: int, seed: int, size: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of every source in one shard."""
    counts = np.array(dealt, dtype=np.int64)
    low, high, begin = 0, -(-int(counts.sum()) // size), np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        held = split(counts, (middle - low) * size, np.random.default_rng([seed, low, high]))
        if shard < middle:
            counts, high = held, middle
        else:
            begin, counts, low = begin + held, counts - held, middle
    return begin, counts


def plan(docs: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id", share: float = 1.5,
         most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), keep: list[str] | None = None,
         seed: int = SEED) -> Mix:
    """Sizes, targets and the place of every document in its source's stream of words.

    Sources by code point, null last, take `weights` in turn. Null and empty texts have no words; they stand in
    no block. Repeated rows are packed each; ties in `order` are broken by size and text, so reruns agree. A
    table of one row per source and chunk is all that the driver or one task sees at once of a hot source.
    `docs` is read twice, once for its number of rows alone; its kept columns are shuffled and stored once.
    Kept columns named like one of the mix's own (`OWN`) get underscores behind their names.
    """
    kept = [c for c in (docs.columns if keep is None else keep)]
    renamed, used = {}, {c.lower() for c in docs.columns} | OWN
    for c in docs.columns:
        if c.lower() in OWN:
            new = f"{c}_"
            while new.lower() in used:
                new += "_"
            used.add(new.lower())
            renamed[c] = new
    docs = docs.withColumnsRenamed(renamed)
    kept = [renamed.get(c, c) for c in kept]
    text, source, order = (renamed.get(c, c) for c in (text, source, order))
    names = {n: fresh(docs, n) for n in ("size", "chunk", "upto", "mark")}
    size, chunk = F.col(names["size"]), names["chunk"]
    # A hot source has as many chunks as a chunk has rows of it, so neither window outgrows the root of the rows.
    chunks = max(1, math.isqrt(docs.count()))
    sized = docs.select(*dict.fromkeys([*kept, source, order]), n_words(F.col(text)).alias(names["size"]),
                        F.xxhash64(F.col(order), F.col(text)).alias(names["mark"])).withColumn(chunk, F.pmod(names["mark"], F.lit(chunks)))
    inside = F.sum(size).over(W.partitionBy(source, chunk).orderBy(names["mark"], order, names["size"]).rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    # The one table with the kept columns: rows already stand in their places inside a chunk. What a chunk begins at is joined when the table is read.
    placed = checkpointed(sized.withColumn(names["upto"], inside))
    totals = placed.groupBy(F.col(source).alias("name"), F.col(chunk).alias("chunk")).agg(F.sum(size).alias("n"))
    per_source = totals.groupBy("name").agg(F.sum("n").alias("size")).collect()
    rows = sorted(per_source, key=lambda r: (r["name"] is None, str(r["name"] or "").encode()))
    sizes = [int(r["size"] or 0) for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(i, r["name"]) for i, r in enumerate(rows)], T.StructType([T.StructField("no", T.IntegerType()), T.StructField("of", docs.schema[source].dataType)]))
    before = F.sum("n").over(W.partitionBy("no").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    begins = checkpointed(totals.join(F.broadcast(numbers) if len(rows) < 10_000 else numbers, totals["name"].eqNullSafe(numbers["of"]))
                          .select("name", "chunk", "no", before.alias("before")))
    at = placed.join(begins, placed[source].eqNullSafe(begins["name"]) & (placed[chunk] == begins["chunk"]))
    packed = at.select(*(placed[c] for c in kept), begins["no"].alias("_source_no"), (placed[names["upto"]] + begins["before"]).alias("_offset"), placed[names["size"]].alias("_size"))
    return Mix(packed, [r["name"] for r in rows], sizes, goal, seed, renamed)


def slots(mix: Mix, spark, shard: int = SHARD) -> DataFrame:
    """shard, slot, _source_no, epoch, block: what stands at every place of the output."""
    dealt, blocks, seed = mix.dealt, mix.blocks, mix.seed
    total = sum(dealt)
    shards = -(-total // shard)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                begin, counts = shard_counts(dealt, k, seed, shard)
                held = int(counts.sum())
                place = permute_all(np.arange(held), max(held, 1), seed + 15485863 * (k + 1))
                at = 0
                for s, (b, c) in enumerate(zip(begin.tolist(), counts.tolist())):
                    i = np.arange(b, b + c, dtype=np.int64)
                    for epoch in range(b // blocks[s], (b + c - 1) // blocks[s] + 1) if c else ():
                        mine = i // blocks[s] == epoch
                        number = permute_all(i[mine] % blocks[s], blocks[s], seed + 7919 * s + 104729 * epoch)
                        n = len(number)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int64()), pa.array(place[at : at + c][mine], pa.int64()), pa.array(np.full(n, s), pa.int32()), pa.array(np.full(n, epoch), pa.int32()), pa.array(number, pa.int64())], names=["shard", "slot", "_source_no", "epoch", "block"])
                    at += c

    ids = spark.range(0, shards, 1, max(1, min(shards, 10_000)))
    return ids.mapInArrow(run, "shard long, slot long, _source_no int, epoch int, block long")


def pieces(packed: DataFrame, text: str | None = None) -> DataFrame:
    """Every document cut where blocks end: _source_no, block, from_word, n_words, the other columns, and the
    piece's `words` joined by a space if `text` is given."""
    first, last = F.expr(f"_offset div {BLOCK}"), F.expr(f"(_offset + _size - 1) div {BLOCK}")
    begin = lambda b: F.greatest(b * BLOCK - F.col("_offset"), F.lit(0).cast("long"))
    end = lambda b: F.least((b + 1) * BLOCK - F.col("_offset"), F.col("_size"))
    some = packed.filter("_size > 0")
    fields = lambda b: [b.alias("block"), begin(b).alias("from_word"), (end(b) - begin(b)).alias("n_words")]
    if text is None:
        cut = F.transform(F.sequence(first, last), lambda b: F.struct(*fields(b)))
    else:
        some = some.withColumn("_words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
        joined = lambda b: F.array_join(F.slice("_words", (begin(b) + 1).cast("int"), (end(b) - begin(b)).cast("int")), " ")
        cut = F.transform(F.sequence(first, last), lambda b: F.struct(*fields(b), joined(b).alias("words")))
    rest = [c for c in packed.columns if c not in {"_words", text}]
    return some.select(*rest, F.explode(cut).alias("_cut")).select(*rest, "_cut.*")


def mixed(mix: Mix, text: str | None = None) -> DataFrame:
    """The output: shard, slot, epoch, _source_no, block, and the pieces of documents that fill the block.

    Blocks and slots meet by (source, number); keys are spread evenly, whatever a source's share of the rows.
    An empty table gives no rows.
    """
    # Spark can't see how many slots a shard makes, so it would take them for a small table to broadcast.
    found = pieces(mix.packed, mix.renamed.get(text, text))
    return slots(mix, mix.packed.sparkSession).hint("shuffle_merge").join(found, ["_source_no", "block"])


def taken(mix: Mix, columns: list[str]) -> DataFrame:
    """One row per document row: `columns`, size, source_size, target, taken (its words in the output, each
    time counted)."""
    columns = [mix.renamed.get(c, c) for c in columns]
    keys = [*columns, "_source_no", "_offset", "_size"]
    every = mix.packed.select(*keys, F.lit(0).cast("long").alias("n"))
    drawn = mixed(mix).select(*keys, F.col("n_words").alias("n"))
    full = every.filter("_size > 0").unionByName(drawn).groupBy(*keys).agg(F.sum("n").alias("taken"))
    none = every.filter("_size = 0").withColumnRenamed("n", "taken")
    sizes = F.array(*(F.lit(s).cast("long") for s in mix.sizes)) if mix.sizes else F.array(F.lit(None).cast("long"))
    goal = F.array(*(F.lit(t) for t in mix.goal)) if mix.goal else F.array(F.lit(None).cast("double"))
    return full.unionByName(none).select(*columns, F.col("_size").alias("size"), sizes[F.col("_source_no")].alias("source_size"),
                                         goal[F.col("_source_no")].alias("target"), "taken")
