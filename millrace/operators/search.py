"""Search a registry of named objects, and keep it current."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import InvalidInput

# Query words used, default and longest result.
MAX_WORDS = 8
DEFAULT_LIMIT = 20
MAX_LIMIT = 50


def query_words(query: str) -> list[str]:
    words = [w.lower() for w in re.findall(r"\w+", query)]
    if len(words) > MAX_WORDS:
        raise InvalidInput(f"a query has at most {MAX_WORDS} words")
    return words


def _starts_a_word(word: str) -> str:
    # A word is a run of letters, digits and underscores in any script. The word stands first, so that the
    # scan looks for its letters and only then behind them.
    return rf"{word}(?<![\p{{L}}\p{{N}}\p{{M}}_]{word})"


def matches(text: Column, words: list[str]) -> Column:
    """True where every query word begins some word of the text."""
    return reduce(lambda a, b: a & b, [text.contains(w) & text.rlike(_starts_a_word(w)) for w in words])


def search(refs: DataFrame, query: str, text: list[str], name: str = "name", limit: int = DEFAULT_LIMIT,
           projects: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Objects whose words all match, best first, then by name.

    The rank is the number of words a query word begins. `projects` lists the project ids the user may
    see; objects without a project are open to all. Filters run before ranking, and the result is a
    distributed top-k.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidInput(f"the limit must be between 1 and {MAX_LIMIT}")
    words = query_words(query.strip())
    if not words:
        return refs.withColumn("rank", F.lit(0).cast("bigint")).limit(0)
    if kinds:
        refs = refs.filter(F.col("kind").isin(kinds))
    body = F.lower(F.concat_ws(" ", *text))
    found = refs.withColumn("_body", body).filter(matches(F.col("_body"), words))
    if projects is not None:
        mine = projects.select(F.col("project_id").alias("_mine")).distinct()
        found = found.join(mine, F.col("project_id") == F.col("_mine"), "left").filter(
            "project_id IS NULL OR _mine IS NOT NULL").drop("_mine")
    rank = reduce(lambda a, b: a + b, [F.regexp_count("_body", F.lit(_starts_a_word(w))) for w in words])
    return (
        found.withColumn("rank", rank.cast("bigint")).drop("_body")
        .orderBy(F.col("rank").desc(), F.col(name)).limit(limit)
    )


def upsert(refs: DataFrame, changes: DataFrame, at: str = "updated_at") -> DataFrame:
    """The registry with changes applied: the last write per (kind, project_id, name) wins."""
    keys = ["kind", "project_id", "name"]
    both = refs.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(at))
    return both.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*refs.columns)


def remove(refs: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["kind", "project_id", "name"]
    condition = reduce(lambda a, b: a & b, [refs[k].eqNullSafe(gone[k]) for k in keys])
    return refs.join(gone, condition, "left_anti")
