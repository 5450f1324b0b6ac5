"""Column helpers for formulas, filters and splits.

Arithmetic is null-safe on a zero denominator even with ANSI mode on, comparisons with None
mean IS NULL, and text building passes NULL through.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidInput

# Size limits on user-written expressions.
MAX_TEXT_LITERAL = 10_000
MAX_EXPRESSION = 4_000

# Characters a trim removes.
WHITESPACE = " \t\n\r\x0b\x0c"

_TYPE_NAMES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "string": "string",
    "varchar": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "binary": "binary",
}


def col(df: DataFrame, name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    if name not in df.columns:
        raise InvalidInput(f"unknown column {name!r}")
    return df["`" + name.replace("`", "``") + "`"]


def lit(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and len(value) > MAX_TEXT_LITERAL:
        raise InvalidInput("text literal is too long")
    if value is None or isinstance(value, (bool, int, float, str)):
        return F.lit(value)
    raise InvalidInput(f"{type(value).__name__} is not a literal an expression may use")


def type_name(name: str) -> str:
    """Spark type for a recipe type name; `decimal(p,s)` and Spark names pass through."""
    key = name.strip().lower()
    target = _TYPE_NAMES.get(key, key)
    try:
        T._parse_datatype_string(target)
    except Exception as error:
        raise InvalidInput(f"unknown type {name!r}") from error
    return target


def _nonzero(value: Any) -> Column:
    return F.nullif(lit(value), F.lit(0))


def divide(a: Any, b: Any) -> Column:
    return lit(a) / _nonzero(b)


def floor_divide(a: Any, b: Any) -> Column:
    return F.floor(lit(a) / _nonzero(b))


def modulo(a: Any, b: Any) -> Column:
    """The sign follows the dividend, as in SQL."""
    return lit(a) % _nonzero(b)


def power(a: Any, b: Any) -> Column:
    return F.pow(lit(a), lit(b))


def equal(a: Any, b: Any) -> Column:
    if a is None or b is None:
        return lit(b if a is None else a).isNull()
    return lit(a) == lit(b)


def not_equal(a: Any, b: Any) -> Column:
    if a is None or b is None:
        return lit(b if a is None else a).isNotNull()
    return lit(a) != lit(b)


_COMPARE = {
    "==": equal,
    "!=": not_equal,
    "<": lambda a, b: lit(a) < lit(b),
    "<=": lambda a, b: lit(a) <= lit(b),
    ">": lambda a, b: lit(a) > lit(b),
    ">=": lambda a, b: lit(a) >= lit(b),
}


def compare(first: Any, *rest: Any) -> Column:
    """`compare(0, "<", x, "<", 10)`: every neighbouring pair must hold."""
    operators, operands = rest[0::2], (first, *rest[1::2])
    if not operators or len(operands) != len(operators) + 1:
        raise InvalidInput("a comparison alternates values and operators")
    unknown = [op for op in operators if op not in _COMPARE]
    if unknown:
        raise InvalidInput(f"comparison {unknown[0]!r} is not allowed")
    pairs = [_COMPARE[op](operands[i], operands[i + 1]) for i, op in enumerate(operators)]
    return reduce(lambda x, y: x & y, pairs)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def negate(condition: Column) -> Column:
    return ~condition


def trim(value: Any) -> Column:
    return F.btrim(lit(value), F.lit(WHITESPACE))


def replace(value: Any, old: str, new: str) -> Column:
    """Literal replacement, no pattern syntax."""
    return F.replace(lit(value), F.lit(old), F.lit(new))


def round_to(value: Any, digits: int = 0) -> Column:
    return F.round(lit(value), digits)


def concat(*parts: Any) -> Column:
    """Cast every part to text and join; one NULL part makes the result NULL."""
    if not parts:
        raise InvalidInput("concat needs at least one part")
    return F.concat(*(lit(part).cast("string") for part in parts))


def if_else(condition: Column, then: Any, otherwise: Any) -> Column:
    """A NULL condition takes the else branch."""
    return F.when(condition, lit(then)).otherwise(lit(otherwise))


def cast(value: Any, name: str) -> Column:
    return lit(value).cast(type_name(name))


upper, lower, length = F.upper, F.lower, F.length
year, month, day = F.year, F.month, F.dayofmonth
absolute, coalesce = F.abs, F.coalesce
