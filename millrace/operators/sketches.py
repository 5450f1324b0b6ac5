"""Column profiles that can be added up: counts, bounds, sums and two sketches per column, a row each.

A version's sketches are taken once, in one aggregation, and written beside it. The profile of a dataset that grows by
appended versions is the merge of their sketches, a few kilobytes a column: only the new rows are read. Quantiles come from a KLL
sketch, distinct counts from a HyperLogLog one; both merge without a loss beyond their own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.expressions import col
from millrace.operators.profile import kind_of

# Size of a quantile sketch: a rank is off by less than RANK_ERROR with 99% confidence.
K, RANK_ERROR = 400, 0.0075
# log2 of the buckets of a distinct count: a standard error of 1.6%.
LOG_BUCKETS = 12

SCHEMA = "name string, type string, kind string, rows bigint, filled bigint, low double, high double, total double, distinct binary, quantiles binary"


def as_number(c: Column, kind: str, type_name: str) -> Column | None:
    """What is ordered and summed: numbers as they are without NaN, dates and times as seconds, nothing for other kinds."""
    if kind == "other":
        return None
    if kind == "numeric":
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    return (F.unix_date(c).cast("double") * 86_400 if type_name == "date" else c.cast("timestamp").cast("double"))


def sketch(df: DataFrame, k: int = K) -> DataFrame:
    """One row per column of `df` (SCHEMA), in one pass.

    `filled` counts what isn't null. `low`, `high`, `total` and `quantiles` are of numbers and times, NaN aside, and null where
    there are none; `distinct` is null for columns of maps, lists and structs. A table without rows has rows of zeros and nulls.
    """
    measures, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        c, kind, type_name = col(df, field.name), kind_of(field.dataType), field.dataType.typeName()
        number = as_number(c, kind, type_name)
        measures.append(F.count(c).alias(f"n{i}"))
        simple = type_name not in ("map", "array", "struct", "variant")
        if simple:
            # 0.0 and -0.0 are one value.
            spelled = (c + F.lit(0).cast(field.dataType) if kind == "numeric" else c).cast("string")
            measures.append(F.hll_sketch_agg(spelled, LOG_BUCKETS).alias(f"d{i}"))
        if number is not None:
            measures += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.sum(number).alias(f"t{i}"),
                         F.kll_sketch_agg_double(number, k).alias(f"q{i}")]
        of_number = lambda p, t: F.col(f"{p}{i}") if number is not None else F.lit(None).cast(t)
        rows.append(F.struct(
            F.lit(field.name).alias("name"), F.lit(field.dataType.simpleString()).alias("type"), F.lit(kind).alias("kind"), F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("filled"), of_number("lo", "double").alias("low"), of_number("hi", "double").alias("high"), of_number("t", "double").alias("total"),
            (F.col(f"d{i}") if simple else F.lit(None).cast("binary")).alias("distinct"),
            F.when(F.col(f"lo{i}").isNotNull(), F.col(f"q{i}")).otherwise(F.lit(None).cast("binary")).alias("quantiles") if number is not None
            else F.lit(None).cast("binary").alias("quantiles")))
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def merged(sketches: DataFrame) -> DataFrame:
    """The sketches of all versions as one row per column and type: as if all rows had been sketched at once, but for the
    sketches' own error. A column that changed its type keeps a row of each."""
    return sketches.groupBy("name", "type", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.when(F.count("distinct") > 0, F.hll_union_agg("distinct")).alias("distinct"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"))


def appended(kept: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """What is kept, grown by new rows: nothing else is read."""
    return merged(kept.unionByName(sketch(rows, k)))


def shown(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """name, type, kind, row_count, null_count, distinct_approx, low, high, mean, quantiles (at `shares`)."""
    return sketches.select(
        "name", "type", "kind", F.col("rows").alias("row_count"), (F.col("rows") - F.col("filled")).alias("null_count"),
        F.hll_sketch_estimate("distinct").alias("distinct_approx"), "low", "high",
        F.try_divide("total", F.kll_sketch_get_n_double("quantiles")).alias("mean"),
        F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, shares)))).alias("quantiles"))
