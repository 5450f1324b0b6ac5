"""A stored index for prefix searches: postings sorted by term, written in generations, merged when asked.

A generation holds `postings` (term, block, places, counts), range-partitioned and sorted by term, and `entries`, one row per
object that it adds, replaces or removes. The objects with one word are cut into blocks of keys, so no list
outgrows a block however common the word is; keys are stored as places in their block, small numbers that parquet packs. A search reads the terms that
begin with its words, which parquet finds by the ranges of its row groups, and no text.

An object counts as its newest generation says. `merge` writes one generation that replaces all before it. Generations are
numbered folders and are there once their entries are complete, so a write that failed leaves nothing that is read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.operators.search import DEFAULT_LIMIT, MAX_LIMIT, query_words
from millrace.session import checkpointed, partitions_for

# Keys a block of postings spans.
BLOCK = 1 << 16
WORD = r"[\p{L}\p{N}\p{M}_]+"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[str]:
    """The generations a search reads, oldest first: from the newest merged one on."""
    where, files = _folder(spark, path)
    if not files.exists(where):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(where))
    done = [n for n in names if files.exists(_folder(spark, f"{path}/{n}/entries/_SUCCESS")[0])]
    merged = [i for i, n in enumerate(done) if n.endswith("-merged")]
    return done[merged[-1]:] if merged else done


def _next(spark: SparkSession, path: str, suffix: str = "") -> str:
    """A number above all there are, unfinished ones too."""
    where, files = _folder(spark, path)
    taken = [int(f.getPath().getName().split("-")[0]) for f in files.listStatus(where)] if files.exists(where) else []
    return f"{path}/{max(taken, default=0) + 1:08d}{suffix}"


def _listed(words: DataFrame) -> DataFrame:
    """term, block, places, counts of `words` (key, words), a list for each batch of objects."""
    schema = T.StructType.fromDDL("term string, block long, places array<int>, counts array<int>")

    def run(batches):
        for batch in batches:
            keys, lists = np.asarray(batch.column(0)), batch.column(1)
            said = lists.flatten().dictionary_encode()
            terms = len(said.dictionary)
            pairs, n = np.unique(np.asarray(pc.list_parent_indices(lists)).astype(np.int64) * max(terms, 1) + np.asarray(said.indices), return_counts=True)
            key, term = keys[pairs // max(terms, 1)], pairs % max(terms, 1)
            block = key // BLOCK
            order = np.lexsort((key, block, term))
            key, term, block, n = key[order], term[order], block[order], n[order]
            starts = np.flatnonzero(np.concatenate([[len(key) > 0], (np.diff(term) != 0) | (np.diff(block) != 0)])) if len(key) else np.zeros(0, dtype=np.int64)
            bounds = pa.array(np.append(starts, len(key)), pa.int32())
            yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(term[starts])), pa.array(block[starts]), pa.ListArray.from_arrays(bounds, pa.array((key - block * BLOCK).astype(np.int32))),
                                              pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32)))], names=schema.names)

    return words.mapInArrow(run, schema)


def _pairs() -> Column:
    return F.arrays_zip(F.col("places").alias("place"), F.col("counts").alias("n"))


def _write(lists: DataFrame, entries: DataFrame, target: str) -> None:
    """`lists`: term, block, places, counts, any number for a term and block. They are dealt by range once and put together
    there. Postings first: the entries make the generation count."""
    lists = checkpointed(lists)
    dealt = lists.select("term", "block", _pairs().alias("p")).repartitionByRange(partitions_for(lists, 64 << 20), "term", "block")
    whole = dealt.groupBy("term", "block").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    coded = whole.select("term", "block", F.col("p.place").alias("places"), F.col("p.n").alias("counts"))
    coded.sortWithinPartitions("term", "block").write.parquet(f"{target}/postings")
    entries.write.parquet(f"{target}/entries")


def write(refs: DataFrame, path: str, text: list[str], key: str, columns: list[str], removed: DataFrame | None = None) -> None:
    """Add a generation: the objects of `refs`, new or in place of those with the same integer `key`, and the keys of
    `removed`. `columns` are kept for filters, order and results; all generations of an index keep the same. The last of
    several rows with one key isn't defined, so keys must be unique; null keys are refused."""
    spark = refs.sparkSession
    own = refs.select(F.col(key).cast("long").alias("key"), F.struct(*columns).alias("kept"), F.lower(F.concat_ws(" ", *text)).alias("body"))
    own = own.withColumn("key", F.when(F.col("key").isNull(), F.raise_error(F.lit("an object without a key"))).otherwise(F.col("key")))
    words = own.select("key", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"))
    entries = own.select("key", "kept", F.lit(True).alias("live"))
    if removed is not None:
        gone = removed.select(F.col(key).cast("long").alias("key")).distinct().join(own.select("key"), "key", "left_anti")
        entries = entries.unionByName(gone.select("key", F.lit(None).cast(entries.schema["kept"].dataType).alias("kept"), F.lit(False).alias("live")))
    _write(_listed(words), entries, _next(spark, path))


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    names = generations(spark, path)
    if not names:
        raise InvalidInput(f"there is no index at {path}")
    # One scan per generation, and few of them: merge when there are many.
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{path}/{n}/{what}").withColumn("generation", F.lit(i)) for i, n in enumerate(names)])


def _current(spark: SparkSession, path: str) -> DataFrame:
    """key, kept, generation of the objects that are there."""
    newest = _read(spark, path, "entries").groupBy("key").agg(F.max_by(F.struct("kept", "live", "generation"), "generation").alias("e"))
    return newest.filter("e.live").select("key", "e.kept", "e.generation")


def _places(postings: DataFrame) -> DataFrame:
    """term, key, n, generation of coded postings."""
    return postings.select("term", "generation", "block", F.explode(_pairs()).alias("x")).select(
        "term", "generation", (F.col("block") * BLOCK + F.col("x.place")).alias("key"), F.col("x.n").cast("long").alias("n"))


def merge(spark: SparkSession, path: str) -> None:
    """Replace all generations by one, without the postings of replaced and removed objects. The places that a generation
    has lost are bits, 64 in a number and BLOCK in a row, so lists are thinned out where they are and never taken apart."""
    current = checkpointed(_current(spark, path))
    lost = _read(spark, path, "entries").filter("live").join(current, ["key", "generation"], "left_anti")
    block = F.floor(F.col("key") / BLOCK).cast("long")
    place = (F.col("key") - block * BLOCK).cast("int")
    word = lost.select("generation", block.alias("block"), (place / 64).cast("int").alias("at"), (place % 64).alias("bit"))
    words = word.groupBy("generation", "block", "at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = words.groupBy("generation", "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    dead = checkpointed(found.select("generation", "block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("dead")))
    stays = lambda x: F.getbit(F.get("dead", (x["place"] / 64).cast("int")), x["place"] % 64) == 0
    kept = F.when(F.col("dead").isNull(), _pairs()).otherwise(F.filter(_pairs(), stays))
    live = _read(spark, path, "postings").join(dead, ["generation", "block"], "left").select("term", "block", kept.alias("p")).filter("size(p) > 0")
    _write(live.select("term", "block", F.col("p.place").alias("places"), F.col("p.n").alias("counts")), current.select("key", "kept", F.lit(True).alias("live")), _next(spark, path, "-merged"))


def postings_of(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The postings of all terms that begin with one of the words."""
    any_word = reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in words])
    return _read(spark, path, "postings").filter(any_word)


def found(spark: SparkSession, path: str, words: list[str], where: Column | None = None) -> DataFrame:
    """The kept columns and the rank of all objects in which each of the words begins a word. The rank is the number of
    words that one of them begins, as `search.search` counts it on the texts. `where` is a condition on the kept columns."""
    begun = [F.col("term").startswith(w) for w in words]
    times = reduce(lambda a, b: a + b, [b.cast("int") for b in begun])
    which = reduce(lambda a, b: a.bitwiseOR(b), [F.when(b, 1 << i).otherwise(0) for i, b in enumerate(begun)])
    hits = _places(postings_of(spark, path, words)).select("key", "generation", (F.col("n") * times).alias("n"), which.alias("which"))
    ranked = hits.groupBy("key", "generation").agg(F.sum("n").alias("rank"), F.bit_or("which").alias("which")).filter(F.col("which") == (1 << len(words)) - 1)
    objects = ranked.join(_current(spark, path), ["key", "generation"]).select("kept.*", "rank")
    return objects if where is None else objects.filter(where)


def search(spark: SparkSession, path: str, query: str, name: str, limit: int = DEFAULT_LIMIT, where: Column | None = None) -> DataFrame:
    """The best of what the words of `query` find (`found`), then by `name`: a distributed top-k."""
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidInput(f"the limit must be between 1 and {MAX_LIMIT}")
    words = query_words(query.strip())
    if not words:
        return _current(spark, path).select("kept.*", F.lit(0).cast("bigint").alias("rank")).limit(0)
    return found(spark, path, words, where).orderBy(F.col("rank").desc(), F.col(name)).limit(limit)
