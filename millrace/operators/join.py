"""Equi joins with predictable names, and an exact way through hot keys.

By default the physical join is Spark's choice: broadcast below the size threshold it measures,
sort-merge with runtime skew splitting above it. `hot_rows` adds salting for keys known to be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.session import checkpointed, require_columns

HOW = ("inner", "left", "right", "outer")


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str = "inner",
    right_suffix: str = "_right",
    hot_rows: int | None = None,
) -> DataFrame:
    """NULL keys never match. Right columns whose name the left already has get `right_suffix`.

    A key with one name on both sides is kept once in an inner join, where both copies are equal;
    in the other joins the right copy stays, suffixed, since it can be NULL.
    """
    if how not in HOW:
        raise InvalidInput(f"how must be one of {HOW}")
    if not on or len(right_suffix) > 32:
        raise InvalidInput("a join needs key pairs and a suffix of at most 32 characters")
    require_columns(left, [l for l, _ in on])
    require_columns(right, [r for _, r in on])
    shared = {l for l, r in on if l == r} if how == "inner" else set()
    taken = {c.lower() for c in left.columns}
    names = {c: (c + right_suffix if c.lower() in taken else c) for c in right.columns}
    output = [*left.columns, *(names[c] for c in right.columns if c not in shared)]
    if len({c.lower() for c in output}) != len(output):
        raise InvalidInput(f"the join would give duplicate names: {output}")
    renamed = right.select(*(col(right, c).alias(n) for c, n in names.items()))
    pairs = [(l, names[r]) for l, r in on]
    if hot_rows is None:
        joined = left.join(renamed, _all(col(left, l) == col(renamed, r) for l, r in pairs), how)
    else:
        joined = _salted(left, renamed, pairs, how, hot_rows)
    return joined.select(*(F.col("`" + c.replace("`", "``") + "`") for c in output))


def _row_hash(df: DataFrame):
    """A hash of the row's own values: a task that runs again salts its rows as before. Copies of one row
    share a salt; runtime skew splitting takes care of a great many of them."""
    return F.xxhash64(*(col(df, f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")))


def _salted(left, right, pairs, how, hot_rows):
    """Join with the left rows of each hot key spread over several salts.

    A hot key is one with more than `hot_rows` left rows; it gets one salt per `hot_rows` rows. Only
    the right rows of hot keys are copied, once per salt. A right join is a left join with the sides
    swapped; an outer join adds the unmatched right rows to a left join.
    """
    if how == "right":
        return _salted(right, left, [(r, l) for l, r in pairs], "left", hot_rows)
    if how == "outer":
        kept = _salted(left, right, pairs, "left", hot_rows)
        # Each key once, so a hot key of the left side is one row to look up.
        known = left.select(*(col(left, l) for l, _ in pairs)).distinct()
        condition = _all(col(known, l) == col(right, r) for l, r in pairs)
        return kept.unionByName(right.join(known, condition, "left_anti"), allowMissingColumns=True)
    lk, rk = [l for l, _ in pairs], [r for _, r in pairs]
    hot = checkpointed(
        left.groupBy(*(col(left, l).alias(f"_h{i}") for i, l in enumerate(lk)))
        .agg(F.ceil(F.count("*") / F.lit(hot_rows)).cast("int").alias("_salts"))
        .filter("_salts > 1")
    )
    match = lambda side, keys: _all(col(side, k) == hot[f"_h{i}"] for i, k in enumerate(keys))
    drops = [f"_h{i}" for i in range(len(lk))]
    # Each hot key stands for more than `hot_rows` rows, so the list has fewer entries than
    # rows / hot_rows; Spark still measures the checkpointed list before it broadcasts it.
    big = (
        left.join(hot, match(left, lk), "left").drop(*drops)
        .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(_row_hash(left), F.col("_salts"))))
        .drop("_salts")
    )
    small = (
        right.join(hot, match(right, rk), "left").drop(*drops)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    condition = _all(col(big, l) == col(small, r) for l, r in pairs) & (big["_salt"] == small["_copy"])
    return big.join(small, condition, how).drop("_salt", "_copy")
