"""SQL-step function names that Spark spells differently, as Catalyst-inlined SQL functions.

Each is a temporary SQL function, so the optimizer inlines its body: no Python and no JVM closure.
Names that Spark already uses with another meaning get a name of their own, listed in RENAMED.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from millrace.errors import InvalidInput

# Written name -> name to call.
RENAMED = {
    "log": "log10",
    "mod": "try_mod",
    "date_diff": "step_date_diff",
    "list": "collect_list",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "json_extract": "get_json_object",
}

# Strftime letters and the matching Spark pattern letters.
PATTERN_LETTERS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy",
    "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%f": "SSSSSS",
    "%a": "EEE", "%A": "EEEE", "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s",
}

_PIECE = re.compile(r"%-?.|[^%]+|%", re.DOTALL)


def spark_pattern(written: str) -> str:
    """A strftime format as a Spark pattern; text that is no letter code is quoted."""
    pieces, plain = [], ""
    for piece in [*_PIECE.findall(written), None]:
        if piece is not None and (piece == "%%" or not piece.startswith("%")):
            plain += "%" if piece == "%%" else piece
            continue
        if plain:
            pieces.append("'" + plain.replace("'", "''") + "'")
            plain = ""
        if piece is not None:
            if piece not in PATTERN_LETTERS:
                raise InvalidInput(f"{piece!r} is not a known part of a date format")
            pieces.append(PATTERN_LETTERS[piece])
    return "".join(pieces)


def _pattern_sql(name: str) -> str:
    sql = name
    for letter, spark in PATTERN_LETTERS.items():
        sql = f"replace({sql}, '{letter}', '{spark}')"
    return sql


def _ticks(unit: str, value: str) -> str:
    """How many whole units have begun by `value`: differences count crossed boundaries."""
    seconds = {"second": 1, "minute": 60, "hour": 3600}
    if unit in seconds:
        return f"unix_seconds(date_trunc('{unit}', {value})) div {seconds[unit]}"
    return {
        "day": f"unix_date(to_date({value}))",
        "week": f"unix_date(to_date(date_trunc('week', {value}))) div 7",
        "month": f"year({value}) * 12 + month({value})",
        "quarter": f"year({value}) * 4 + quarter({value})",
        "year": f"year({value})",
    }[unit]


_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
_DATE_DIFF = " ".join(
    f"WHEN '{u}' THEN CAST(({_ticks(u, 'stop')}) - ({_ticks(u, 'start')}) AS BIGINT)" for u in _UNITS
)

_FUNCTIONS = (
    "strlen(s STRING) RETURNS BIGINT RETURN CAST(octet_length(s) AS BIGINT)",
    f"strftime(t TIMESTAMP, f STRING) RETURNS STRING RETURN date_format(t, {_pattern_sql('f')})",
    f"strptime(s STRING, f STRING) RETURNS TIMESTAMP RETURN to_timestamp(s, {_pattern_sql('f')})",
    "step_date_diff(unit STRING, start TIMESTAMP, stop TIMESTAMP) RETURNS BIGINT "
    f"RETURN CASE lower(unit) {_DATE_DIFF} END",
)


def prepare_session(spark: SparkSession) -> SparkSession:
    """A session whose temporary functions and views no other step can see."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        session.conf.set(key, spark.conf.get(key))
    for body in _FUNCTIONS:
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return session
