"""Stack, split, sample, top values, paging, latest row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.operators.prepare import Expression, as_column
from millrace.session import require_columns

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Bounds and defaults of the sample recipe.
DEFAULT_ROWS = 1000
MAX_ROWS = 10_000_000
DEFAULT_SEED = 42


def stack(*frames: DataFrame) -> DataFrame:
    """Union all by name. Columns appear in first-seen order; a missing one is a typed NULL.

    Types must agree up to numeric widening: Spark on its own would turn text + int into a bigint
    that fails while running.
    """
    if len(frames) < 2:
        raise InvalidInput("stack needs at least two inputs")
    seen: dict[str, T.DataType] = {}
    for frame in frames:
        for field in frame.schema.fields:
            known = seen.setdefault(field.name, field.dataType)
            both_numbers = isinstance(known, _NUMERIC) and isinstance(field.dataType, _NUMERIC)
            if known != field.dataType and not both_numbers:
                raise InvalidInput(
                    f"{field.name} is {known.simpleString()} in one input and "
                    f"{field.dataType.simpleString()} in another"
                )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split(df: DataFrame, expression: Expression, null_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(match, rest). A row whose predicate is NULL is in neither, unless `null_to="rest"`."""
    predicate = as_column(df, expression)
    if null_to == "rest":
        predicate = F.coalesce(predicate, F.lit(False))
    elif null_to is not None:
        raise InvalidInput("null_to is None or 'rest'")
    return df.filter(predicate), df.filter(~predicate)


def write_split(df: DataFrame, expression: Expression, path: str) -> None:
    """Write both outputs in one scan, as `path/branch=match` and `path/branch=rest`."""
    predicate = as_column(df, expression)
    (df.withColumn("branch", F.when(predicate, "match").when(~predicate, "rest"))
       .filter("branch IS NOT NULL")
       .write.mode("overwrite").partitionBy("branch").parquet(path))


# Types whose values a sample can hash.
_HASHED = frozenset(
    {"byte", "short", "integer", "long", "float", "double", "decimal", "string", "boolean", "binary",
     "date", "timestamp", "timestamp_ntz", "array", "struct"}
)


def _fingerprint(df: DataFrame, columns: list[str], seed: int) -> Column:
    text = lambda c: F.hex(col(df, c)) if df.schema[c].dataType.typeName() == "binary" else col(df, c).cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(text(c), F.lit("\x00")) for c in columns)))


def sample(
    df: DataFrame,
    method: str = "head",
    n: int | None = DEFAULT_ROWS,
    fraction: float | None = None,
    seed: int = DEFAULT_SEED,
    columns: list[str] | None = None,
) -> DataFrame:
    """First `n` rows, or each row with probability `fraction`.

    The random draw hashes the row's own values, so it does not depend on partitioning, a retry
    draws the same rows, and no shuffle is needed. Identical rows are drawn together. Without a
    fraction, `random` falls back to the first `n` rows.
    """
    if method not in ("head", "random"):
        raise InvalidInput("method is head or random")
    if method == "random" and fraction is not None:
        if not 0 < fraction <= 1:
            raise InvalidInput("fraction must be in (0, 1]")
        chosen = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in _HASHED]
        draw = F.conv(F.substring(_fingerprint(df, chosen, seed), 1, 8), 16, 10).cast("bigint")
        return df.filter(draw < F.lit(int(fraction * 2**32)))
    rows = DEFAULT_ROWS if n is None else n
    if not 1 <= rows <= MAX_ROWS:
        raise InvalidInput(f"n must be between 1 and {MAX_ROWS}")
    return df.limit(rows)


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent non-NULL values of each column: (column, value, n, position).

    One scan for all columns. Counts combine before the shuffle, and the rank limit keeps k rows per
    column per task before the ranking itself, so a column with a billion distinct values sends k.
    """
    require_columns(df, columns)
    long = df.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column"), col(df, c).cast("string").alias("value"))
                           for c in columns)))
    ).filter("value IS NOT NULL")
    best = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return (
        long.groupBy("column", "value").agg(F.count("*").alias("n"))
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k)
    )


def page_after(df: DataFrame, key: str, cursor, limit: int, descending: bool = False) -> DataFrame:
    """One keyset page plus one row: `limit + 1` rows after (or before) the cursor, in key order.

    A full extra row tells the caller that there is a next page; the last row kept is its cursor.
    """
    require_columns(df, [key])
    c = col(df, key)
    if cursor is not None:
        df = df.filter(c < cursor if descending else c > cursor)
    return df.orderBy(c.desc() if descending else c.asc()).limit(limit + 1)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, by a map-side combined max."""
    require_columns(df, [*keys, *order])
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)
