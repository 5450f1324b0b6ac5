"""Profile a dataset in two passes, whatever its number of columns.

One aggregation gives counts, approximate distincts, bounds and means of all columns; one grouped count
gives the most frequent values of all text and boolean columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import col
from millrace.operators.combine import top_values

TOP_VALUES = 5
DISTINCT_ERROR = 0.05


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def summary(df: DataFrame, distinct_error: float = DISTINCT_ERROR) -> DataFrame:
    """One row per column: name, type, kind, row_count, null_count, distinct_approx, min, max, mean.

    Bounds are text, as they are shown; `mean` is a double.
    """
    measures, rows = [F.count(F.lit(1)).alias("rows")], []
    text, none = T.StringType(), F.lit(None)
    for i, field in enumerate(df.schema.fields):
        c, kind = col(df, field.name), kind_of(field.dataType)
        measures.append(F.count(c).alias(f"n{i}"))
        countable = field.dataType.typeName() not in ("map", "variant")
        if countable:
            measures.append(F.approx_count_distinct(c, distinct_error).alias(f"d{i}"))
        if kind != "other":
            measures += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if kind == "numeric":
            measures.append(F.avg(c).alias(f"m{i}"))
        bound = lambda p: F.col(f"{p}{i}").cast(text) if kind != "other" else none.cast(text)
        rows.append(F.struct(
            F.lit(field.name).alias("name"), F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(kind).alias("kind"), F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            (F.col(f"d{i}") if countable else none.cast("bigint")).alias("distinct_approx"),
            bound("lo").alias("min"), bound("hi").alias("max"),
            (F.col(f"m{i}").cast("double") if kind == "numeric" else none.cast("double")).alias("mean"),
        ))
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def profile(df: DataFrame, distinct_error: float = DISTINCT_ERROR) -> DataFrame:
    """`summary` plus top_values: an array of (value, count), most frequent first, ties by value."""
    out = summary(df, distinct_error)
    other = [f.name for f in df.schema.fields
             if kind_of(f.dataType) == "other" and f.dataType.typeName() in ("string", "boolean")]
    if not other:
        return out.withColumn("top_values", F.lit(None).cast("array<struct<value:string,count:bigint>>"))
    # At most five rows per column reach this gather.
    best = top_values(df, other, TOP_VALUES).groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value", "n"))),
            lambda s: F.struct(s["value"].alias("value"), s["n"].alias("count")),
        ).alias("top_values"))
    return out.join(best, out["name"] == best["column"], "left").drop("column")
