"""Ordered computations (running totals, neighbours, ranks, trailing ranges, medians) on any key skew.

A plain window puts a whole key into one task. That is right for keys of up to HOT_ROWS rows, and wrong
for a key that holds a third of a large table. So the sizes of the keys are counted first, map-side
combined; ordinary keys take the plain window, and hot keys are cut up.

Rows of hot keys are range-partitioned on (keys, order) and written out, so a key is cut into as many
chunks as its share of the rows asks for. Windows then run inside a (keys, chunk) pair, and what flows
from chunk to chunk is a carry row. Chunks are contiguous in key order, so each chunk continues at most
one key of the chunk before it: there are never more carry rows than chunks, which is what makes their
broadcast safe at any data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.session import checkpointed, partitions_for, stored

CHUNK = "_chunk"

# Rows of one key that a single task may order.
HOT_ROWS = 1_000_000


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys])


def split_hot(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than `hot_rows` rows or None)."""
    sizes = df.groupBy(*(F.col(k).alias(f"_h_{k}") for k in keys)).agg(F.count("*").alias("_n"))
    hot, found = stored(sizes.filter(F.col("_n") > hot_rows).drop("_n"))
    if not found:
        return df, None
    # Fewer hot keys than rows / hot_rows; Spark measures the stored list before it picks a join.
    same = _same(df, hot, keys, "_h_")
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def by_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running sums (`totals`: new name -> value, inclusive) and the previous / following row's value of
    a column (new name -> column), per key in `order`, which ends in a unique column."""
    plain, hot = split_hot(df, keys, hot_rows)
    place = W.partitionBy(*keys).orderBy(*order)
    upto = place.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = plain.withColumns({
        **{n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in (totals or {}).items()},
        **{n: F.lag(c).over(place) for n, c in (previous or {}).items()},
        **{n: F.lead(c).over(place) for n, c in (following or {}).items()},
    })
    if hot is None:
        return out
    cut = chunked(hot, keys, order)
    if previous or following:
        cut = neighbours(cut, keys, order, previous, following)
    if totals:
        cut = running(cut, keys, order, totals)
    return out.unionByName(cut.drop(CHUNK))


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add `_chunk`: increasing in (keys, order), and stored, so reruns see the same cut.

    `order` must end in a unique column: that lets a single hot value be split too.
    """
    ranged = df.repartitionByRange(chunks or partitions_for(df), *keys, *order)
    return checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _inside(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def _across(keys: list[str]):
    # One row per (key, chunk): a hot key contributes at most one row per chunk.
    return W.partitionBy(*keys).orderBy(CHUNK)


def with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join the carry rows (at most one per chunk) onto their chunk."""
    renamed = carry.withColumnsRenamed({k: f"_c_{k}" for k in [*keys, CHUNK]})
    condition = reduce(
        lambda a, b: a & b,
        [df[k].eqNullSafe(renamed[f"_c_{k}"]) for k in [*keys, CHUNK]],
    )
    return df.join(renamed, condition, "left").drop(*(f"_c_{k}" for k in [*keys, CHUNK]))


def running(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums to a chunked frame: `totals` maps new name -> value."""
    upto = _inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, CHUNK)
        .agg(*(F.sum(value).alias(f"_t_{name}") for name, value in totals.items()),
             F.lit(1).alias("_one"))
        .withColumn("_seen", F.sum("_one").over(before))
        .withColumns({f"_b_{name}": F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0))
                      for name in totals})
        .filter("_seen IS NOT NULL")
        .select(*keys, CHUNK, *(f"_b_{name}" for name in totals))
    )
    local = df.withColumns({name: F.coalesce(F.sum(value).over(upto), F.lit(0))
                            for name, value in totals.items()})
    joined = with_carry(local, carry, keys)
    return joined.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)) for name in totals}
    ).drop(*(f"_b_{name}" for name in totals))


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add the previous / following row's value of a column (lag 1 / lead 1) to a chunked frame.

    `previous` and `following` map new name -> source column.
    """
    place = F.struct(*order)
    out = df
    for mapping, shift, pick in ((previous, F.lag, F.max_by), (following, F.lead, F.min_by)):
        if not mapping:
            continue
        edge = (
            df.groupBy(*keys, CHUNK)
            .agg(*(pick(F.struct(F.col(src).alias("v")), place).alias(f"_e_{name}")
                   for name, src in mapping.items()))
            .withColumns({f"_n_{name}": shift(f"_e_{name}").over(_across(keys)) for name in mapping})
            .filter(F.col(f"_n_{next(iter(mapping))}").isNotNull())
            .select(*keys, CHUNK, *(f"_n_{name}" for name in mapping))
        )
        # The struct wrapper tells "no neighbour in this chunk" from "neighbour holds NULL".
        local = out.withColumns(
            {f"_l_{name}": shift(F.struct(F.col(src).alias("v"))).over(_inside(keys, order))
             for name, src in mapping.items()}
        )
        out = with_carry(local, edge, keys).withColumns(
            {name: F.coalesce(F.col(f"_l_{name}"), F.col(f"_n_{name}"))["v"] for name in mapping}
        ).drop(*(f"_l_{name}" for name in mapping), *(f"_n_{name}" for name in mapping))
    return out


def ranks(df: DataFrame, keys: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `rank` and `dense_rank` of `value` (ascending) within `keys`.

    For hot keys ties are counted first, so the ordered pass sees one row per distinct value.
    """
    plain, hot = split_hot(df, keys, hot_rows)
    place = W.partitionBy(*keys).orderBy(value)
    out = plain.withColumns({n: f().over(place).cast("bigint") for n, f in (("rank", F.rank), ("dense_rank", F.dense_rank))})
    if hot is None:
        return out
    counts = hot.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running(
        chunked(counts, keys, [value]), keys, [value], {"_upto": F.col("_n"), "dense_rank": F.lit(1)}
    ).withColumn("rank", F.col("_upto") - F.col("_n") + 1)
    both = [*keys, value]
    right = placed.select(
        *(F.col(c).alias(f"_r_{c}") for c in both), "rank", F.col("dense_rank").cast("bigint").alias("dense_rank"))
    return out.unionByName(hot.join(right, _same(hot, right, both, "_r_")).drop(*(f"_r_{c}" for c in both)))


def trailing(
    df: DataFrame, keys: list[str], at: str, row_id: str, span: str, totals: dict[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per row, sums over the rows of the same key with `at` in [this - span, this]: row_id, keys, totals.

    `span` is an interval of fixed length (weeks to microseconds, not months). Time of a hot key is cut into
    buckets as long as the span, so a frame is the end of one bucket and the beginning of the next: a running
    total backwards and one forwards, each read at a mark the row sends there. No frame is ever buffered, and
    nothing is subtracted, so an infinity or a large value stays inside the frames that hold it.
    """
    slim = df.select(*keys, F.col(at).alias("_at"), F.col(row_id).alias("_id"),
                     *(value.alias(name) for name, value in totals.items()))
    if not isinstance(df.select(F.expr(f"INTERVAL {span}").alias("s")).schema["s"].dataType, T.DayTimeIntervalType):
        raise InvalidInput(f"INTERVAL {span} has no fixed length")
    plain, hot = split_hot(slim, keys, hot_rows)
    name = lambda c: "`" + c.replace("`", "``") + "`"
    frame = (f"PARTITION BY {', '.join(map(name, keys))} ORDER BY _at "
             f"RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW")
    out = plain.select(F.col("_id").alias(row_id), *keys,
                       *(F.expr(f"coalesce(sum({name(n)}) OVER ({frame}), 0)").alias(n) for n in totals))
    if hot is None:
        return out
    kind_of = {n: out.schema[n].dataType for n in totals}
    # Clock time without a zone has no gaps, so it counts microseconds of any date.
    zoned = isinstance(slim.schema["_at"].dataType, T.TimestampType)
    micros = F.expr("unix_micros(_at)" if zoned else
                    "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(_at AS TIMESTAMP_NTZ))")
    length = F.expr(f"unix_micros(TIMESTAMP'1970-01-01 00:00:00' + INTERVAL {span}) - unix_micros(TIMESTAMP'1970-01-01 00:00:00')")
    width = F.greatest(length, F.lit(1))
    timed = hot.withColumns({"_t": micros, "_b": micros - F.pmod(micros, width)})

    def mark(bucket: Column, side: int, place: Column, kind: int) -> Column:
        values = [F.coalesce(F.col(n) if kind == 0 else F.lit(0), F.lit(0)).cast(kind_of[n]).alias(n) for n in totals]
        return F.struct(bucket.alias("_bucket"), F.lit(side).alias("_side"), place.alias("_place"), F.lit(kind).alias("_kind"), *values)

    bucket, moment = F.col("_b"), F.col("_t")
    forwards = [mark(bucket, 0, moment, 0), mark(bucket, 0, moment, 1)]
    backwards = [mark(bucket, 1, -moment, 0), mark(bucket - width, 1, length - moment, 1)]
    # Rows without a time see each other, as in a plain window, and have no bucket before theirs.
    every = F.when(moment.isNull(), F.array(*forwards)).otherwise(F.array(*forwards, *backwards))
    marks = timed.select(*keys, F.inline(every), "_id")
    order = ["_place", "_kind", "_id"]
    series = [*keys, "_side", "_bucket"]
    summed = running(chunked(marks, series, order), series, order, {f"_s_{n}": F.col(n) for n in totals}).filter("_kind = 1")
    far = summed.groupBy(F.col("_id").alias(row_id), *keys).agg(*(F.sum(f"_s_{n}").cast(kind_of[n]).alias(n) for n in totals))
    return out.unionByName(far)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per key.

    The values of a hot key are not held in one task: count each distinct value, run the counts in order,
    keep the values standing on the middle positions.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    plain, hot = split_hot(known, keys, hot_rows)
    out = plain.groupBy(*keys).agg(F.median(value).alias(name))
    if hot is None:
        return out
    cut = chunked(hot.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, [value])
    placed = running(cut, keys, [value], {"_upto": F.col("_n")})
    total = cut.groupBy(*(F.col(k).alias(f"_r_{k}") for k in keys)).agg(F.sum("_n").alias("_total"))
    both = placed.join(total, _same(placed, total, keys, "_r_")).drop(*(f"_r_{k}" for k in keys))
    low, high = F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1")
    covers = lambda place: (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
    return out.unionByName(both.filter(covers(low) | covers(high)).groupBy(*keys).agg(F.avg(value).alias(name)))


def ends(df: DataFrame, keys: list[str], order: list[str], first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """Add the first / last row's value of a column per key (`first`, `last` over a whole partition).

    One map-side combined aggregation and a join back; Spark splits that join at runtime if a key is hot.
    """
    place = F.struct(*order)
    found = df.groupBy(*(F.col(k).alias(f"_r_{k}") for k in keys)).agg(
        *(F.min_by(c, place).alias(n) for n, c in first.items()),
        *(F.max_by(c, place).alias(n) for n, c in last.items()))
    return df.join(found, _same(df, found, keys, "_r_")).drop(*(f"_r_{k}" for k in keys))
