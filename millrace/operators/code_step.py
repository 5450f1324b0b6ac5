"""Python steps: user functions over DataFrames, kept off specially protected inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from millrace.errors import InvalidInput, PolicyBlocked
from millrace.operators.labels import blocking_labels


def code_step(inputs: dict[str, DataFrame], function: Callable[..., DataFrame],
              labels: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """Call `function(**inputs)`; it returns one DataFrame.

    `labels` gives (classification, bbn level) per input; a bijzonder, bsn or bbn3 input is refused
    before the function sees anything.
    """
    blocked = sorted({b for c, level in (labels or {}).values() for b in blocking_labels(c, level)})
    if blocked:
        raise PolicyBlocked(f"code steps cannot read inputs labelled {', '.join(blocked)}")
    out = function(**inputs)
    if not isinstance(out, DataFrame):
        raise InvalidInput("a code step returns one DataFrame")
    return out


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a pandas function batch by batch on the executors; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
