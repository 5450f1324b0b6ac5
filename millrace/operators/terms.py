"""From the words people write to the values a dataset holds, misspelled ones included.

The index keeps every distinct value of the asked columns under its deletion neighbourhood: the spellings that are left when up
to `edits` characters are taken out. Two texts at most that many insertions, deletions and replacements apart have a
spelling in common, so a join on hashes of spellings finds all of them, and their distance is then computed. Nothing is
compared with everything, and values are counted before they are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col

EDITS, MATCHES = 2, 5


def folded(text: Column) -> Column:
    """How terms and values are compared: lower case, blanks single and none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def spellings(text: Column, edits: int) -> Column:
    """The distinct hashes of what is left of a text without up to `edits` of its characters: about length ** edits / edits! of them."""
    def shorter(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: i > 0)
        return F.transform(places, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    left = everything = F.array(text)
    for _ in range(edits):
        left = F.array_distinct(F.flatten(F.transform(left, shorter)))
        everything = F.concat(everything, left)
    return F.array_distinct(F.transform(everything, lambda x: F.xxhash64(x)))


def index(df: DataFrame, columns: list[str], edits: int = EDITS) -> DataFrame:
    """attribute, value, rows, spelled, key: a row per spelling of each distinct value of the columns.

    Nulls and blank values are left out. Write it as a table to ask it more than once.
    """
    if not columns:
        raise InvalidInput("no columns to index")
    each = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("attribute"), col(df, c).cast("string").alias("value")) for c in columns))))
    values = each.filter("value IS NOT NULL").groupBy("attribute", "value").agg(F.count("*").alias("rows"))
    spelled = values.withColumn("spelled", folded(F.col("value"))).filter("spelled <> ''")
    return spelled.select("*", F.explode(spellings(F.col("spelled"), edits)).alias("key"))


def resolve(terms: DataFrame, term: str, spelled: DataFrame, edits: int = EDITS, matches: int = MATCHES) -> DataFrame:
    """term, place, attribute, value, edits, rows: the `matches` nearest values of each distinct term, at most `edits` apart.

    Nearer values come first, then the more frequent, then by attribute and value. Terms without a value near them, null and blank
    ones have no row. `edits` must not be above the index's.
    """
    if edits < 0 or matches < 1:
        raise InvalidInput("edits can't be negative, and one match is the least")
    asked = terms.select(col(terms, term).cast("string").alias("term")).distinct().withColumn("asked", folded(F.col("term"))).filter("asked <> ''")
    # Terms that fold alike are looked up once; a value is met by many of its spellings and measured once.
    keys = asked.select("asked").distinct().select("asked", F.explode(spellings(F.col("asked"), edits)).alias("key"))
    met = keys.join(spelled, "key").select("asked", "attribute", "value", "rows", "spelled").distinct()
    near = met.withColumn("edits", F.levenshtein("asked", "spelled", edits)).filter("edits >= 0")
    order = W.partitionBy("asked").orderBy("edits", F.col("rows").desc(), "attribute", "value")
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= matches)
    return asked.join(best, "asked").select("term", "place", "attribute", "value", "edits", "rows")
