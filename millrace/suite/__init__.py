"""Registered queries: each operator on whole test tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.oracles[function.__name__] = sql
            return function

        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def everything() -> Suite:
    from millrace.suite import books, flows, recipes, sql, texts

    whole = Suite()
    for module in (recipes, sql, flows, texts, books):
        whole.queries.update(module.suite.queries)
        whole.oracles.update(module.suite.oracles)
    return whole
