"""Records of CSV files as rows, read by many tasks though quoted fields hold line breaks.

Spark's text source cuts a file into blocks and hands out lines; a line belongs to the block it begins in. Whether a line
begins a record or goes on inside a quoted field hangs on all quotes before it. A block turns each of two states at its
start, outside and inside a quoted field, into the state at its end: it keeps the state, swaps it, or forces one. These
maps are made by all blocks at once and composed by a prefix scan over a row per block; then every block knows its start
and cuts its own lines into records. A record that crosses blocks is put together from their fragments, at most two per
block.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.session import checkpointed

# From inside a quoted field to behind its closing quote; doubled quotes belong to the field.
_TO_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')

_BLOCK = ["file", "start"]


def inside_after(line: str, inside: bool) -> bool:
    """Whether the end of `line` lies in a quoted field, if its beginning did or not. A quote opens a field only at its
    first character; behind a closing quote the field goes on to the next comma."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"')
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        closed = _TO_CLOSE.match(line, at)
        if closed is None:
            return True
        if line.startswith(",", closed.end()):
            at = closed.end() - 1  # the comma may be followed by a quote at once
        else:
            at = closed.end()
        at = line.find(',"', at)
        if at < 0:
            return False
        at += 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _blocks(batches, columns):
    """(values of `columns` that are one for a block, its lines' batches one by one as a generator), in order."""
    def runs(batch):
        files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        begin = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[begin] or starts[i] != starts[begin]:
                yield (files[begin], starts[begin], *(batch.column(c)[begin].as_py() for c in columns)), batch.column(0).slice(begin, i - begin)
                begin = i

    for batch in batches:
        yield from runs(batch)


def _states(lines: DataFrame) -> DataFrame:
    """file, start, before, after: the state (inside a quoted field or not) at the start and the end of every block."""
    def run(batches):
        now, ends = None, (False, True)
        done = []
        for block, values in _blocks(batches, ()):
            if block != now:
                if now is not None:
                    done.append((*now, *ends))
                now, ends = block, (False, True)
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                ends = tuple(inside_after(line, e) for e in ends)
        if now is not None:
            done.append((*now, *ends))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                                         names=["file", "start", "outside", "inside"])

    maps = checkpointed(lines.mapInArrow(run, "file string, start long, outside boolean, inside boolean"))
    # A block that forces a state cuts off what was before; between such blocks only swaps count. One row per block.
    upto = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    swaps = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(upto)
    forced = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("to"), F.col("swaps").alias("since")))
    scanned = maps.withColumn("swaps", swaps).withColumn("forced", F.last(forced, ignorenulls=True).over(upto))
    after = (F.coalesce(F.col("forced.to"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("forced.since"), F.lit(0))) % 2 == 1
    known = scanned.withColumn("after", after)
    known = known.withColumn("before", F.coalesce(F.lag("after").over(W.partitionBy("file").orderBy("start")), F.lit(False)))
    return checkpointed(known.select(*_BLOCK, "before", "after"))


def _cut(batches, whole: bool):
    """Records that lie in one block if `whole`, else the fragments of those that don't: (file, start, place, opens, text). The first record
    of a file is at place 0."""
    def emit(rows):
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["file", "start", "place", "opens", "text"])

    now, held, inside, place, first = None, [], False, 0, True
    rows = []

    def ended():
        # What is held belongs to a record that goes on in the next block, or whose end the file lacks.
        if held and not whole:
            rows.append((*now, place, opens, "\n".join(held)))

    opens = True
    for (file, start, before), values in _blocks(batches, (3,)):
        if (file, start) != now:
            ended()
            if before is None:
                raise RuntimeError(f"{file} was cut into other blocks than before")
            now, held, inside, place, opens = (file, start), [], before, 0, not before
        quoted = pc.match_substring(values, '"').to_pylist()
        for line, has_quote in zip(values.to_pylist(), quoted):
            if has_quote:
                inside = inside_after(line, inside)
            held.append(line)
            if not inside:
                if whole == opens:
                    rows.append((*now, place, opens, "\n".join(held)))
                held, opens, place = [], True, place + 1
        if len(rows) >= 10_000:
            yield emit(rows)
            rows = []
    ended()
    yield emit(rows)


def records(spark: SparkSession, path: str) -> DataFrame:
    """text, first: the records of the CSV files at `path`, in no order, and which are the first of their files.

    Records end at a line feed outside quotes; a carriage return before it is left out, and so are empty records.
    """
    lines = _lines(spark, path)
    states = _states(lines)
    # A row per block, so a millionth of the input or less at the usual block size.
    joined = lambda only, how: lines.join(F.broadcast(only), _BLOCK, how).select("value", *_BLOCK, "before")
    schema = "file string, start long, place long, opens boolean, text string"
    out = joined(states, "left").mapInArrow(lambda batches: _cut(batches, True), schema)
    crossing = states.filter("before OR after")
    if not crossing.isEmpty():
        parts = joined(crossing, "inner").mapInArrow(lambda batches: _cut(batches, False), schema)
        # A fragment that opens a record begins a new one; those behind it go on with it.
        upto = W.partitionBy("file").orderBy("start", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
        numbered = parts.withColumn("record", F.sum(F.col("opens").cast("int")).over(upto))
        pieces = F.sort_array(F.collect_list(F.struct("start", "place", "text")))
        put = numbered.groupBy("file", "record").agg(pieces.alias("p"))
        out = out.unionByName(put.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["place"].alias("place"), F.lit(True).alias("opens"), F.array_join(F.col("p.text"), "\n").alias("text")))
    first = (F.col("start") == 0) & (F.col("place") == 0)
    text = F.regexp_replace("text", r"\r\z", "")
    return out.select(F.when(first, F.ltrim(text, F.lit("﻿"))).otherwise(text).alias("text"), first.alias("first")).filter("first OR trim(text) <> ''")
