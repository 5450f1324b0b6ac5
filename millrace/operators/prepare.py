"""The prepare recipe: an ordered list of column and row steps, each fed by the previous one.

Steps are dicts with an `op`. All of them are narrow except dedupe, so a prepare recipe without a
dedupe compiles to one scan with pushed filters and pruned columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col, lit, type_name
from millrace.operators.checked_sql import checked_expression
from millrace.session import require_columns, unused

Expression = Column | str | Callable[[DataFrame], Column]


def as_column(df: DataFrame, expression: Expression) -> Column:
    """A Column, a function of the frame, or a checked SQL expression string."""
    if isinstance(expression, str):
        return checked_expression(df, expression)
    return expression(df) if callable(expression) and not isinstance(expression, Column) else expression


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One select, so a swap of two names works; an unknown old name is an error."""
    require_columns(df, mapping)
    names = [mapping.get(c, c) for c in df.columns]
    if len({n.lower() for n in names}) != len(names):
        raise InvalidInput(f"renaming would give duplicate names: {names}")
    return df.select(*(col(df, c).alias(n) for c, n in zip(df.columns, names)))


def _same(df: DataFrame, name: str, value: Column) -> Column:
    """`value` under the name and with the metadata, labels among it, of the column it stands for."""
    return value.alias(name, metadata=df.schema[name].metadata)


def cast(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    require_columns(df, casts)
    return df.withColumns({c: _same(df, c, col(df, c).cast(type_name(t))) for c, t in casts.items()})


def filter_rows(df: DataFrame, expression: Expression) -> DataFrame:
    return df.filter(as_column(df, expression))


def formula(df: DataFrame, column: str, expression: Expression) -> DataFrame:
    return df.withColumn(column, as_column(df, expression))


def fill_nulls(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    require_columns(df, values)
    return df.withColumns({c: _same(df, c, F.coalesce(col(df, c), lit(v))) for c, v in values.items()})


def dedupe(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Whole-row distinct, or the first whole row per `subset`.

    "First" is by `order`, then by the rest of the row, so reruns agree. The rank filter lets Spark
    keep one row per key per map task before the shuffle, so a hot key ships few rows.
    """
    if not subset:
        return df.distinct()
    require_columns(df, [*subset, *(order or [])])
    lead = order or []
    rest = [f.name for f in df.schema.fields
            if f.name not in subset and f.name not in lead and f.dataType.typeName() not in ("map", "variant")]
    sort = [col(df, c).asc_nulls_last() for c in [*lead, *rest]] or [F.lit(0)]
    first = W.partitionBy(*(col(df, c) for c in subset)).orderBy(*sort)
    (place,) = unused(df, "_rn")
    return df.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)


def select(df: DataFrame, columns: list[str], drop: bool = False) -> DataFrame:
    require_columns(df, columns)
    keep = [c for c in df.columns if c not in columns] if drop else columns
    return df.select(*(col(df, c) for c in keep))


_STEPS = {
    "rename": (rename, "mapping"),
    "cast": (cast, "casts"),
    "filter": (filter_rows, "expression"),
    "formula": (formula, "column", "expression"),
    "fill_nulls": (fill_nulls, "values"),
    "dedupe": (dedupe,),
    "select": (select, "columns"),
}
_OPTIONAL = {"dedupe": ("subset", "order"), "select": ("drop",)}


def prepare(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    if not steps:
        raise InvalidInput("a prepare recipe needs at least one step")
    for step in steps:
        if step.get("op") not in _STEPS:
            raise InvalidInput(f"unknown prepare step {step.get('op')!r}")
        function, *required = _STEPS[step["op"]]
        missing = [name for name in required if not step.get(name)]
        if missing:
            raise InvalidInput(f"{step['op']} needs {missing}")
        optional = {n: step[n] for n in _OPTIONAL.get(step["op"], ()) if n in step}
        df = function(df, *(step[name] for name in required), **optional)
    return df
