"""File sources: scan, infer, convert, validate, sample."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.sources.delimited import records

# Preview and sample sizes.
PREVIEW_ROWS = 50
SAMPLE_DEFAULT, SAMPLE_MAX = 100, 1000

_A_VALUE = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|\d{4}-\d{1,2}-\d{1,2}([ T].*)?|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|(?i:true|false)")
_SMALL_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def _allowed(limit: int) -> int:
    if not 1 <= limit <= SAMPLE_MAX:
        raise InvalidInput(f"the limit must be between 1 and {SAMPLE_MAX}")
    return limit


def _parsed(spark: SparkSession, texts: DataFrame, schema: T.StructType | None = None, **options: Any) -> DataFrame:
    """Records as Spark's own CSV parser reads them."""
    reader = spark.read.options(quote='"', escape='"', multiLine=True, mode="FAILFAST", **options)
    if schema is not None:
        reader = reader.schema(schema)
    held = getattr(texts.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(held), spark)


def _field_names(written: list[str | None]) -> list[str]:
    """Names of a header line: a place for an empty one, and its place behind one that occurs again."""
    known = [n.lower() for n in written if n]
    return [f"_c{i}" if not n else f"{n}{i}" if known.count(n.lower()) > 1 else n for i, n in enumerate(written)]


def read_csv(spark: SparkSession, path: str, header: bool | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with types inferred from every row, or with a given schema and no inference pass.

    Without `header`, the first line counts as one unless it holds a number, date or truth value. Integers
    become bigint. Quoted fields may hold commas, doubled quotes and line breaks; a file is read by many tasks all the
    same (`delimited`). A record with another number of fields than the first fails the read, and so does a file with
    another header than the others.
    """
    texts = records(spark, path)
    # One row per file: its first record, parsed to know names and whether there is a header at all.
    firsts = texts.filter("first AND trim(text) <> ''").select("text").distinct().limit(2).collect()
    if not firsts:
        return spark.createDataFrame([], schema or T.StructType())
    head = list(_parsed(spark, spark.createDataFrame(firsts[:1], "text string")).first())
    if header is None:
        header = not any(v and _A_VALUE.fullmatch(v.strip()) for v in head)
    names = _field_names(head) if header else [f"_c{i}" for i in range(len(head))]
    if header and len(firsts) > 1:
        raise InvalidInput(f"the files at {path} have different header lines")
    if schema is not None and (len(schema) != len(names) or (header and [n.lower() for n in names] != [n.lower() for n in schema.names])):
        raise InvalidInput(f"the file has the columns {names}, not {schema.names}")
    rows = texts.filter("NOT first" if header else "trim(text) <> ''")
    if schema is not None:
        return _parsed(spark, rows, schema)
    df = _parsed(spark, rows, inferSchema=True, preferDate=True, timestampType="TIMESTAMP_NTZ")
    if not df.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    if len(df.columns) != len(names):
        raise InvalidInput(f"a record has {len(df.columns)} fields, the header {len(names)}")
    return df.toDF(*names).select(*(
        F.col(_quoted(n)).cast("bigint").alias(n) if isinstance(f.dataType, _SMALL_INTEGERS) else F.col(_quoted(n))
        for n, f in zip(names, df.schema.fields)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_file(spark: SparkSession, path: str) -> DataFrame:
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return read_csv(spark, path)
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith(".xlsx"):
        from millrace.sources.workbook import read_workbook

        return read_workbook(spark, path)
    raise InvalidInput("expected a .csv, .parquet or .xlsx file")


def object_path(bucket: str, relative: str) -> str:
    """The URI of a registered parquet object; the path stays inside its bucket."""
    if not relative.endswith(".parquet") or relative.startswith("/") or ".." in relative.split("/"):
        raise InvalidInput("give a relative path ending in .parquet, without ..")
    return f"s3a://{bucket}/{relative}"


def json_value(value: Any) -> Any:
    """A value as JSON can hold it: non-finite floats become null, decimals and times text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.date, dt.datetime, dt.time)):
        return value.isoformat()
    if isinstance(value, T.Row):
        return {k: json_value(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_value(v) for v in value]
    return str(value) if isinstance(value, (decimal.Decimal, uuid.UUID, bytes, bytearray)) else str(value)


def rows_as_json(df: DataFrame, limit: int) -> list[dict[str, Any]]:
    """At most SAMPLE_MAX rows, for display."""
    return [{k: json_value(v) for k, v in row.asDict().items()} for row in df.take(_allowed(limit))]


@dataclass(frozen=True)
class Inferred:
    schema: T.StructType
    preview: list[dict[str, Any]]
    format: str


def infer(spark: SparkSession, path: str, preview_rows: int = PREVIEW_ROWS) -> Inferred:
    df = read_file(spark, path)
    if not df.columns:
        raise InvalidInput("the file has no columns to import")
    return Inferred(df.schema, rows_as_json(df, preview_rows), path.rsplit(".", 1)[-1].lower())


def write_counted(df: DataFrame, path: str, **options: str) -> int:
    """Overwrite `path` with parquet; the row count comes from the same job."""
    return write_measured(df, path, [], **options)[0]


def write_measured(df: DataFrame, path: str, measures: list[Column], **options: str) -> tuple[int, list[Any]]:
    """`write_counted`, and the values of further aggregates over the written rows, from the same job too."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *named).write.mode("overwrite").options(**options).parquet(path)
    return int(seen.get["rows"]), [seen.get[f"m{i}"] for i in range(len(measures))]


def convert(spark: SparkSession, path: str, target: str) -> tuple[T.StructType, int]:
    """An upload as typed parquet: (schema, rows)."""
    df = read_file(spark, path)
    if not df.columns:
        raise InvalidInput("the file has no columns to import")
    return df.schema, write_counted(df, target)


def validate(spark: SparkSession, path: str, full: bool = False) -> tuple[T.StructType, int]:
    """(schema, rows) of a parquet dataset; unreadable data is an error. `full` reads every page, where a
    count reads footers only."""
    try:
        df = spark.read.parquet(path)
        if not full:
            return df.schema, df.count()
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return df.schema, int(seen.get["rows"])
    except Exception as error:
        raise InvalidInput(f"{path} could not be read as parquet") from error


def sample_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The first rows, in no order: 1 to 1000, 100 by default."""
    return df.limit(_allowed(SAMPLE_DEFAULT if limit is None else limit))


def finite(df: DataFrame) -> DataFrame:
    """The JSON view of a table: NaN and infinities become NULL."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def shown(name: str) -> Column:
        c = col(df, name)
        return F.when(~bad(c), c).alias(name) if name in floats else c

    return df.select(*(shown(c) for c in df.columns))
