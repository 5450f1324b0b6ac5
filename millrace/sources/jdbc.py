"""Tables of a relational database, read only, in parallel ranges of a numeric or time column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import InvalidInput
from millrace.sources.files import write_counted

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


@dataclass(frozen=True)
class Database:
    url: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"
    fetch_rows: int = 10_000


def quoted(schema: str, table: str) -> str:
    for part in (schema, table):
        if not part or "\x00" in part:
            raise InvalidInput("give a schema and a table name")
    return ".".join('"' + p.replace('"', '""') + '"' for p in (schema, table))


def _reader(spark: SparkSession, db: Database):
    return spark.read.format("jdbc").options(
        url=db.url, user=db.user, password=db.password, driver=db.driver, fetchsize=db.fetch_rows,
        sessionInitStatement="SET default_transaction_read_only = on")


def read_table(spark: SparkSession, db: Database, schema: str, table: str, split_on: str | None = None,
               partitions: int = 1) -> DataFrame:
    """Filters and columns are pushed into the database. With `split_on`, its bounds are asked for first
    and the table is read in that many ranges."""
    name = quoted(schema, table)
    reader = _reader(spark, db).option("dbtable", name)
    if split_on is None or partitions <= 1:
        return reader.load()
    if not _NAME.fullmatch(split_on):
        raise InvalidInput(f"cannot split on {split_on!r}")
    low, high = _reader(spark, db).option(
        "query", f'SELECT min("{split_on}") AS lo, max("{split_on}") AS hi FROM {name}').load().first()
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=split_on, lowerBound=str(low), upperBound=str(high),
                          numPartitions=str(partitions)).load()


def row_estimate(spark: SparkSession, db: Database, schema: str, table: str) -> int | None:
    """The planner's row estimate; None when the database has none or refuses."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    query = (f"SELECT c.reltuples AS n FROM pg_class c JOIN pg_namespace s ON s.oid = c.relnamespace "
             f"WHERE s.nspname = {text(schema)} AND c.relname = {text(table)}")
    try:
        row = _reader(spark, db).option("query", query).load().first()
    except Exception:
        return None
    return int(row["n"]) if row is not None and row["n"] is not None and row["n"] >= 0 else None


def snapshot(df: DataFrame, path: str, limit: int | None = None) -> int:
    """Write an external table to parquet; a limit caps it for a preview. Returns the rows written."""
    return write_counted(df if limit is None else df.limit(limit), path)
