"""Label rules across the inputs of a recipe, on tables of (output, input) pairs.

Every function groups by the output key. Ladder steps combine map-side as numbers, so the size of a
group does not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidInput
from millrace.functions.expressions import col

# The three ladders, laxest first (None: not set).
LADDERS: dict[str, tuple[str | None, ...]] = {
    "classification": ("none", "persoonsgegevens", "bijzonder", "bsn"),
    "bbn": (None, "bbn1", "bbn2", "bbn3"),
    "confidentiality": (None, "intern", "vertrouwelijk", "geheim"),
}
DERIVED_BASIS = "Derived (see inputs)"
BASIS_SEPARATOR = " · "
# Labels a code step may not read.
BLOCKED_CLASSIFICATIONS = ("bijzonder", "bsn")
BLOCKED_BBN = "bbn3"


def rank(ladder: str, value: Column) -> Column:
    """Step on the ladder; NULL is the lowest, an unknown label the highest."""
    steps = LADDERS[ladder]
    out = F.when(value.isNull(), 0)
    for i, label in enumerate(steps):
        if label is not None:
            out = out.when(value == label, i)
    return out.otherwise(len(steps))


def label(ladder: str, step: Column) -> Column:
    steps = LADDERS[ladder]
    return F.element_at(F.array(*(F.lit(s).cast("string") for s in steps)),
                        F.least(step, F.lit(len(steps) - 1)).cast("int") + 1)


def strictest(labels: Column) -> Column:
    """The strictest classification of an array; an unknown label is stricter than all known ones."""
    top = F.array_max(F.transform(labels, lambda x: F.struct(rank("classification", x).alias("r"), x.alias("v"))))
    return top["v"]


def floors(pairs: DataFrame, output: str, current: dict[str, str] | None = None) -> DataFrame:
    """The strictest label per ladder over an output's inputs.

    `pairs` holds the output key and the input's classification, bbn and confidentiality. With
    `current` (ladder -> column holding the output's present label) a manual raise is never lowered.
    """
    aggregates = []
    for ladder in LADDERS:
        step = F.max(rank(ladder, F.col(ladder)))
        if current and ladder in current:
            step = F.greatest(step, F.max(rank(ladder, F.col(current[ladder]))))
        aggregates.append(step.alias(f"_{ladder}"))
    return pairs.groupBy(output).agg(*aggregates).select(
        output, *(label(ladder, F.col(f"_{ladder}")).alias(ladder) for ladder in LADDERS)
    )


def purposes(pairs: DataFrame, output: str, ordinal: str, codes: str) -> DataFrame:
    """Purposes every input allows, in the first input's order.

    A code stays when as many inputs name it as the output has. Only the first input's codes go into
    the result array, so no group is gathered whole.
    """
    shape = pairs.groupBy(output).agg(
        F.count_distinct(ordinal).alias("_inputs"), F.min_by(codes, ordinal).alias("_first"))
    shared = (
        pairs.select(output, ordinal, F.explode(F.array_distinct(codes)).alias("_code")).distinct()
        .groupBy(output, "_code").agg(F.count("*").alias("_n"))
    )
    kept = (
        shape.join(shared, [output]).filter("_n = _inputs AND array_contains(_first, _code)")
        .groupBy(output).agg(F.collect_list("_code").alias("_kept"))
    )
    return shape.join(kept, [output], "left").select(
        output,
        F.filter("_first", lambda c: F.array_contains(F.coalesce("_kept", F.array().cast("array<string>")), c))
        .alias("purposes"),
    )


def legal_basis(pairs: DataFrame, output: str, ordinal: str, basis: str) -> DataFrame:
    """Different bases in first-seen order, joined; a default text when no input has one.

    Repeats are removed before anything is gathered: the list is as long as an output has different
    bases.
    """
    first = (
        pairs.groupBy(output, basis).agg(F.min(ordinal).alias("_at"))
        .groupBy(output)
        .agg(F.array_sort(F.collect_list(
            F.when(F.coalesce(F.col(basis), F.lit("")) != "", F.struct(F.col("_at"), F.col(basis).alias("b")))
        )).alias("_list"))
    )
    joined = F.array_join(F.transform("_list", lambda s: s["b"]), BASIS_SEPARATOR)
    return first.select(output, F.when(F.size("_list") == 0, DERIVED_BASIS).otherwise(joined).alias("legal_basis"))


def label_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Put a classification on named columns, as field metadata; others keep what they have."""
    unknown = set(labels) - set(df.columns)
    wrong = set(labels.values()) - set(LADDERS["classification"])
    if unknown or wrong:
        raise InvalidInput(f"unknown column(s) {sorted(unknown)} or label(s) {sorted(wrong)}")
    marked = lambda f: col(df, f.name).alias(f.name, metadata={**f.metadata, "classification": labels[f.name]})
    return df.select(*(marked(f) if f.name in labels else col(df, f.name) for f in df.schema.fields))


def column_labels(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata.get("classification", "none") for f in schema.fields}


def explicit_labels(df: DataFrame) -> DataFrame:
    """Every column with its label, `none` included, so that what is derived from it can be told from it."""
    return label_columns(df, column_labels(df.schema))


# Set operations show the metadata of their first side alone.
_MERGES = re.compile(r"^[\s:+|-]*(Union|Intersect|Except)\b", re.M)


def carry_labels(out: DataFrame, *inputs: DataFrame, by_name: bool = False) -> DataFrame:
    """Label the columns of `out`, which was made from `inputs`, each of them through `explicit_labels`.

    Spark carries a column's metadata through selections, joins and renames, not through expressions. So a
    column that is an input's column, whatever its name now, keeps its label, and any other takes the
    strictest label on the inputs; so does every column where a set operation merged some. `by_name`, for
    stacked inputs: the strictest label on the columns of that name.
    """
    strict = lambda found: max(found, key=LADDERS["classification"].index, default="none")
    held = [column_labels(frame.schema) for frame in inputs]
    highest = strict(label for labels in held for label in labels.values())
    if by_name:
        own = {f.name: strict(label for labels in held for name, label in labels.items() if name.lower() == f.name.lower())
               for f in out.schema.fields}
    elif _MERGES.search(out._jdf.queryExecution().analyzed().toString()):
        own = dict.fromkeys(out.columns, highest)
    else:
        own = {f.name: f.metadata.get("classification", highest) for f in out.schema.fields}
    return label_columns(out, own)


def stricter(*found: dict[str, str | None]) -> dict[str, str | None]:
    """The strictest label per ladder of a few label sets; a missing one is the laxest."""
    return {ladder: max((f.get(ladder) or steps[0] for f in found), key=steps.index, default=steps[0])
            for ladder, steps in LADDERS.items()}


def blocking_labels(classification: str | None, bbn: str | None) -> list[str]:
    """Labels that forbid a code step, if any."""
    return sorted({x for x in (classification,) if x in BLOCKED_CLASSIFICATIONS}
                  | ({bbn} if bbn == BLOCKED_BBN else set()))
