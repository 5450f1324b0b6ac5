"""Find and redact personal data in a text column.

Spark's JVM side first asks whether a text can hold anything at all (an @, or digits in a shape some
detector wants); only those texts travel to Python, as Arrow batches. There, checksums and overlaps are settled on
code-point offsets. Values found are never kept, only their kinds and counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# The shapes each detector accepts, in order of precedence.
PATTERNS = {
    "bsn": r"(?<![\d.\-])(\d{8,9}|\d{4}[.\- ]\d{2}[.\- ]\d{3}|\d{3}[.\- ]\d{3}[.\- ]\d{3})(?![\d.\-]\d)",
    "iban": r"(?<![A-Z0-9])([A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4})(?![A-Z0-9])",
    "email": r"(?<![\w.+-])([\w.+-]+@[\w-]+\.[\w.-]{2,})(?![\w.-])",
    "phone": r"(?<![\d+])((?:\+31[ -]?\(?0?\)?|0031[ -]?|0)"
             r"(?:6[ -]?\d{8}|[1-9]\d[ -]?\d{7}|[1-9]\d{2}[ -]?\d{6}))(?!\d)",
}
KINDS = tuple(PATTERNS)
# Two digits, then what can make them part of a match: more digits, a grouped number, or two capitals before.
_HINT = (r"\p{Nd}{2}(?:\p{Nd}{4}|\p{Nd}{2}[.\- ]\p{Nd}{2}[.\- ]\p{Nd}{3}|\p{Nd}[.\- ]\p{Nd}{3}[.\- ]\p{Nd}{3}"
         r"|(?<=[A-Z]{2}\p{Nd}{2}))")
# Weights of the eleven test.
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_REDACTED = T.StructType([
    T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def bsn_ok(candidate: str) -> bool:
    digits = [int(c) for c in candidate if c.isdigit()]
    if len(digits) not in (8, 9) or not any(digits):
        return False
    weights = BSN_WEIGHTS[9 - len(digits):]
    return sum(w * d for w, d in zip(weights, digits)) % 11 == 0


def iban_ok(candidate: str) -> bool:
    code = candidate.replace(" ", "")
    if not 15 <= len(code) <= 34 or not code.isalnum():
        return False
    remainder = 0
    for character in code[4:] + code[:4]:
        number = int(character, 36)
        remainder = (remainder * (100 if number > 9 else 10) + number) % 97
    return remainder == 1


_CHECKS = {"bsn": bsn_ok, "iban": iban_ok}
_COMPILED = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS.items()]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) in text order. The earliest start wins, then the longest match, then the
    detector listed first."""
    found = []
    for rank, (kind, pattern) in enumerate(_COMPILED):
        if kind == "email" and "@" not in text:
            continue
        check = _CHECKS.get(kind)
        for match in pattern.finditer(text):
            if check is None or check(match.group(1)):
                found.append((match.start(1), -match.end(1), rank, kind))
    kept, edge = [], 0
    for start, stop, _, kind in sorted(found):
        if start >= edge:
            kept.append((kind, start, -stop))
            edge = -stop
    return kept


def mask(text: str, places: list[tuple[str, int, int]]) -> str:
    pieces, at = [], 0
    for kind, start, stop in places:
        pieces += [text[at:start], f"<{kind.upper()}>"]
        at = stop
    return "".join([*pieces, text[at:]])


@F.pandas_udf(SPANS)
def _spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else [
            {"kind": k, "start": a, "stop": b} for k, a, b in spans(t)])


@F.pandas_udf(_REDACTED)
def _redacted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        redacted, kinds = [], []
        for text in batch:
            places = spans(text) if text is not None else []
            # An untouched text does not travel back: the JVM still has it.
            redacted.append(mask(text, places) if places else None)
            kinds.append([kind for kind, _, _ in places])
        yield pd.DataFrame({"redacted": redacted, "kinds": kinds})


def may_hold(text: Column) -> Column:
    """True where a detector could match: an @, six digits in a row, a grouped number, or the head of an
    account number. Every pattern above contains one of these."""
    return text.contains("@") | text.rlike(_HINT)


def find(text: Column) -> Column:
    """array<struct<kind,start,stop>>, offsets in code points."""
    return F.coalesce(_spans_of(F.when(may_hold(text), text)), F.array().cast(SPANS))


def redact(df: DataFrame, text: str, out: str = "redacted", kinds: str = "pii_kinds") -> DataFrame:
    """Add the redacted text and the kinds found, one entry per finding, in text order."""
    scanned = df.withColumn("_pii", _redacted(F.when(may_hold(F.col(text)), F.col(text))))
    return scanned.withColumns({
        out: F.coalesce(F.col("_pii.redacted"), F.col(text)),
        kinds: F.coalesce(F.col("_pii.kinds"), F.array().cast("array<string>")),
    }).drop("_pii")


def kind_counts(kinds: Column) -> Column:
    """map<kind, count> of a kinds array, in kind order."""
    present = F.array_sort(F.array_distinct(kinds))
    return F.map_from_arrays(present, F.transform(
        present, lambda k: F.size(F.filter(kinds, lambda x: x == k))))


def totals(df: DataFrame, kinds: str = "pii_kinds") -> DataFrame:
    """Findings and texts per kind over the whole table. Counts combine map-side."""
    counted = df.select(F.explode(kind_counts(F.col(kinds))).alias("kind", "n"))
    return counted.groupBy("kind").agg(F.sum("n").alias("findings"), F.count("*").alias("texts"))


def pre_stage(df: DataFrame, text: str, max_chars: int | None = None) -> DataFrame:
    """The stage before a model call: length of the raw text first, then redaction.

    Adds action (allow, redact, block), rule, redacted, pii_kinds. Redaction has no off switch. A
    blocked text is passed on as it came, for the caller to refuse.
    """
    blocked = F.lit(False) if max_chars is None else F.coalesce(F.length(text) > max_chars, F.lit(False))
    scanned = redact(df.withColumn("_in", F.when(~blocked, F.col(text))), "_in")
    return scanned.withColumns({
        "redacted": F.coalesce("redacted", F.col(text)),
        "action": F.when(blocked, "block").when(F.size("pii_kinds") > 0, "redact").otherwise("allow"),
        "rule": F.when(blocked, "input.max_chars").when(F.size("pii_kinds") > 0, "pii.regex"),
    }).drop("_in")
