"""Checks on a dataset: measures with bounds, all taken in one aggregation, with pass, warn or fail for each."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.operators.checked_sql import checked_expression

PASS, WARN, FAIL = "pass", "warn", "fail"
_OF_COLUMN = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}
MEASURES = ("rows", "null_share", "distinct", "matching_share", *_OF_COLUMN)
Bounds = tuple[float | None, float | None]


@dataclass(frozen=True)
class Check:
    """`measure` of `of` (a column; a SQL condition for matching_share; nothing for rows), and the (low, high) bounds, both
    included, outside of which it warns or fails. `distinct` is approximate, within 5%."""

    name: str
    measure: str
    of: str | None = None
    warn: Bounds | None = None
    fail: Bounds | None = None


def measures(df: DataFrame, checks: Iterable[Check]) -> list[Column]:
    """One aggregate per check, a double, in their order; they fit one `agg` or one Observation."""
    return [_measure(df, c).cast("double") for c in checks]


def _measure(df: DataFrame, check: Check) -> Column:
    if check.measure not in MEASURES or (check.of is None) != (check.measure == "rows"):
        raise InvalidInput(f"{check.measure} of {check.of} can't be checked")
    rows = F.count(F.lit(1))
    if check.measure == "rows":
        return rows
    if check.measure == "matching_share":
        return F.try_divide(F.count_if(checked_expression(df, check.of)), rows)
    c = col(df, check.of)
    if check.measure == "null_share":
        return F.try_divide(F.count_if(c.isNull()), rows)
    return F.approx_count_distinct(c) if check.measure == "distinct" else _OF_COLUMN[check.measure](c)


def _outside(value: float | None, bounds: Bounds | None) -> bool:
    if bounds is None:
        return False
    low, high = bounds
    # What has no value, as a share of no rows, is within no bounds; nor is NaN.
    return value is None or value != value or (low is not None and value < low) or (high is not None and value > high)


def judge(checks: Iterable[Check], values: Iterable[float | None]) -> list[dict[str, Any]]:
    """A dict per check: name, value, status."""
    return [{"name": c.name, "value": v, "status": FAIL if _outside(v, c.fail) else WARN if _outside(v, c.warn) else PASS}
            for c, v in zip(checks, values, strict=True)]


def check(df: DataFrame, checks: list[Check]) -> list[dict[str, Any]]:
    """Judge a dataset as it stands, in one pass."""
    if not checks:
        return []
    return judge(checks, df.agg(*(m.alias(f"m{i}") for i, m in enumerate(measures(df, checks)))).first())
