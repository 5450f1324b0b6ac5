"""Group-by with the recipe's aggregate names. NULL is a group of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.session import require_columns

_FUNCTIONS = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


def group(df: DataFrame, by: list[str], aggregations: list[dict[str, str]]) -> DataFrame:
    """`aggregations`: {"column", "func", "as"}; the name defaults to func_column."""
    if not by or not aggregations:
        raise InvalidInput("a group recipe needs keys and aggregations")
    unknown = [a["func"] for a in aggregations if a["func"] not in _FUNCTIONS]
    if unknown:
        raise InvalidInput(f"unknown aggregate(s) {unknown}")
    require_columns(df, [*by, *(a["column"] for a in aggregations)])
    return df.groupBy(*(col(df, c) for c in by)).agg(
        *(_FUNCTIONS[a["func"]](col(df, a["column"])).alias(a.get("as") or f"{a['func']}_{a['column']}")
          for a in aggregations)
    )
