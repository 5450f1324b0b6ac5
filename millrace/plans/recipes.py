"""Recipes: a kind and a config over ordered inputs, giving one DataFrame (two for split)."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.operators import checked_sql, code_step, combine, group, join, prepare
from millrace.sources.files import finite

# Inputs each kind takes (least, most; None for any number), and outputs it gives.
INPUTS = {
    "prepare": (1, 1), "join": (2, 2), "group": (1, 1), "stack": (2, None),
    "split": (1, 1), "sample": (1, 1), "sql": (1, None), "python": (1, None),
}
OUTPUTS = {kind: 2 if kind == "split" else 1 for kind in INPUTS}
PREVIEW_MAX = 1000


def config_hash(config: dict[str, Any]) -> str:
    """sha256 of the sorted, compact JSON of a config, non-ASCII kept."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


# A number with a fraction or an exponent, or one too long for 64 bits, perhaps inside a text.
_SPELLED_OTHERWISE = r"[0-9](\.|[eE])|[0-9]{19}|NaN|Infinity|-0"


def config_hashes(text: Column) -> Column:
    """The same hash for a column of config texts: a parsed object keeps its keys sorted. Numbers that Spark would write
    another way than `config_hash` (1.0, 1e20) take their texts through the same writer."""
    other = text.rlike(_SPELLED_OTHERWISE)
    plain = F.to_json(F.parse_json(F.when(~other, text)))
    written = F.pandas_udf(_canonical, T.StringType())
    return F.sha2(F.when(other, written(F.when(other, text))).otherwise(plain), 256)


def _pairs(on: list[Any]) -> list[tuple[str, str]]:
    return [(k["left"], k["right"]) if isinstance(k, dict) else tuple(k) for k in on]


def run(kind: str, config: dict[str, Any], inputs: list[DataFrame], **context: Any) -> list[DataFrame]:
    """All outputs of a recipe. Nothing runs until an output is used."""
    if kind not in INPUTS:
        raise InvalidInput(f"unknown recipe kind {kind!r}")
    least, most = INPUTS[kind]
    if len(inputs) < least or (most is not None and len(inputs) > most):
        raise InvalidInput(f"{kind} takes {least}{'' if most == least else ' or more'} input(s)")
    options = {k: v for k, v in config.items() if k != "kind"}
    if kind == "prepare":
        return [prepare.prepare(inputs[0], options["steps"])]
    if kind == "join":
        return [join.join(inputs[0], inputs[1], _pairs(options.pop("on")), **options)]
    if kind == "group":
        return [group.group(inputs[0], options["by"], options["aggregations"])]
    if kind == "stack":
        return [combine.stack(*inputs)]
    if kind == "split":
        return list(combine.split(inputs[0], **options))
    if kind == "sample":
        return [combine.sample(inputs[0], **options)]
    if kind == "sql":
        return [checked_sql.sql_step(inputs, options["query"])]
    names = context.get("names") or [f"in_{i + 1}" for i in range(len(inputs))]
    return [code_step.code_step(dict(zip(names, inputs)), options["function"], context.get("labels"))]


def preview(kind: str, config: dict[str, Any], inputs: list[DataFrame], limit: int = 100,
            external: tuple[int, ...] = ()) -> DataFrame:
    """The first rows of a recipe's first output, as JSON can show them.

    Inputs listed in `external` are cut to the limit before the recipe runs, so a preview never reads a
    whole external table; a join preview can be empty for that reason. Code steps have no preview.
    """
    if kind == "python":
        raise InvalidInput("a code step has no preview")
    if not 1 <= limit <= PREVIEW_MAX:
        raise InvalidInput(f"the limit must be between 1 and {PREVIEW_MAX}")
    rows = limit
    cut = [df.limit(rows) if i in external else df for i, df in enumerate(inputs)]
    return finite(run(kind, config, cut)[0].limit(rows))
