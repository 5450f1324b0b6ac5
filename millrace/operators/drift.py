"""How far the distributions of a dataset moved between two versions.

Exact measures read both versions: Kolmogorov-Smirnov distances walk the ordered values of both sides together, counted
per value first, so a hot value is one row; stability indexes compare counts per value. Sketched measures read the sketches kept with
the versions (`sketches`) and no rows at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.operators import ordered, sketches
from millrace.operators.profile import kind_of

# A share that stands for none in a stability index, so that its logarithm is finite.
FLOOR = 1e-4
# Quantiles of each side by which sketched distances are taken.
GRID = 200


def _sides(base: DataFrame, now: DataFrame, columns: list[str], value) -> DataFrame:
    """name, value, in_base, in_now: the number of rows of each value, combined before the shuffle."""
    if not columns:
        raise InvalidInput("no columns to compare")
    sides = [df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), value(df, c).alias("value"), F.lit(n == 0).alias("base")) for c in columns))))
             for n, df in enumerate((base, now))]
    return sides[0].unionByName(sides[1]).groupBy("name", "value").agg(
        F.count_if("base").alias("in_base"), F.count_if(~F.col("base")).alias("in_now"))


def _number(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    kind = kind_of(data_type)
    if kind == "other":
        raise InvalidInput(f"the column {name} has no order to walk")
    # 0.0 and -0.0 are one value.
    return sketches.as_number(col(df, name), kind, data_type.typeName()) + F.lit(0.0)


def distances(base: DataFrame, now: DataFrame, columns: list[str], hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """name, n_base, n_now, ks: the largest difference between the two cumulative shares of each column of numbers or times.

    Nulls and NaN don't count. `ks` is null for a column without values on one side; a column without any has no row.
    """
    counts = _sides(base, now, columns, _number).filter("value IS NOT NULL")
    upto = ordered.by_order(counts, ["name"], ["value"], {"base_upto": F.col("in_base"), "now_upto": F.col("in_now")}, hot_rows=hot_rows)
    # A row per column: the last running sum is the whole.
    whole = counts.groupBy(F.col("name").alias("of")).agg(F.sum("in_base").alias("n_base"), F.sum("in_now").alias("n_now"))
    gap = F.abs(F.try_divide("base_upto", "n_base") - F.try_divide("now_upto", "n_now"))
    return upto.join(F.broadcast(whole), F.col("name") == F.col("of")).groupBy("name", "n_base", "n_now").agg(F.max(gap).alias("ks"))


def _index(p: Column, q: Column, floor: float) -> Column:
    p, q = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor))
    return (q - p) * F.ln(q / p)


def stability(base: DataFrame, now: DataFrame, columns: list[str], floor: float = FLOOR) -> DataFrame:
    """name, n_base, n_now, psi: the population stability index of each column over its values, null being one of them.

    Shares below `floor` count as `floor`. `psi` is null where one side has no rows.
    """
    # Values are compared as text: a column may have changed its type.
    counts = _sides(base, now, columns, lambda df, c: col(df, c).cast("string"))
    whole = counts.groupBy(F.col("name").alias("of")).agg(F.sum("in_base").alias("n_base"), F.sum("in_now").alias("n_now"))
    part = _index(F.try_divide("in_base", "n_base"), F.try_divide("in_now", "n_now"), floor)
    return counts.join(F.broadcast(whole), F.col("name") == F.col("of")).groupBy("name", "n_base", "n_now").agg(
        F.when((F.col("n_base") > 0) & (F.col("n_now") > 0), F.sum(part)).alias("psi"))


def sketched(base: DataFrame, now: DataFrame, bins: int = 10, floor: float = FLOOR) -> DataFrame:
    """name, psi, ks of two sets of sketches, a row per column of the same name and type that has values on both sides.

    The bins of `psi` are cut at the quantiles of `base`. `ks` is within twice the sketches' rank error and 2 / GRID of the exact one.
    """
    if bins < 2:
        raise InvalidInput("a stability index needs two bins or more")
    own = base.filter("quantiles IS NOT NULL").select("name", "type", F.col("quantiles").alias("p"))
    other = now.filter("quantiles IS NOT NULL").select("name", "type", F.col("quantiles").alias("q"))
    # Spark gives quantiles at fixed shares; the rank of a value is the part of an even grid of them that lies at or below it.
    quantiles = lambda of, shares: F.kll_sketch_get_quantile_double(of, F.array(*map(F.lit, shares)))
    even = [(i + 0.5) / GRID for i in range(GRID)]
    both = own.join(other, ["name", "type"]).select(
        "name", F.array_distinct(quantiles("p", [i / bins for i in range(1, bins)])).alias("edges"), quantiles("p", even).alias("p"), quantiles("q", even).alias("q"))
    at = lambda of, points: F.transform(points, lambda v: F.size(F.filter(of, lambda x: x <= v)) / GRID)
    # Shares between neighbouring edges: ranks with 1 behind, less those with 0 before.
    shares = lambda of: F.zip_with(F.concat(at(of, F.col("edges")), F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), at(of, F.col("edges"))), lambda a, b: a - b)
    grid = F.array_distinct(F.concat("p", "q"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return both.select(
        "name", total(F.zip_with(shares("p"), shares("q"), lambda p, q: _index(p, q, floor))).alias("psi"),
        F.array_max(F.zip_with(at("p", grid), at("q", grid), lambda p, q: F.abs(p - q))).alias("ks"))
