"""XLSX workbooks: first sheet, typed, one Spark task per workbook.

Workbooks are read as binary files and unpacked in Arrow batches on the executors. A folder of
workbooks with one layout reads as one table. The first pass settles names and types, the second
gives rows.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.errors import InvalidInput

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Number formats that show a date or time, and the day number 0 stands for.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_EPOCH = dt.datetime(1899, 12, 30)


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
              if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode", "").lower()))}
    styles = root.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return {i for i, f in enumerate(formats) if f in _DATE_FORMATS or f in custom}


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The file of the sheet that the workbook lists first, whatever its number; by number in a book without a list."""
    names = book.namelist()
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        files = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Type", "").endswith("/worksheet")}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = files.get(sheet.get(f"{_LINK}id"))
            if target:
                return target[1:] if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    if not sheets:
        raise InvalidInput("the workbook has no sheet")
    return min(sheets, key=lambda n: int(re.search(r"\d+", n).group()))


def _cells(content: bytes) -> Iterator[list]:
    """Rows of the first sheet as Python values."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        first = _first_sheet(book)
        texts, dates = _texts(book), _date_styles(book)
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_MAIN}row"):
            values: list = []
            for cell in row.iter(f"{_MAIN}c"):
                kind, raw = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif raw is None:
                    value = None
                elif kind == "s":
                    value = texts[int(raw)]
                elif kind == "b":
                    value = raw == "1"
                elif kind in ("str", "e"):
                    value = raw if kind == "str" else None
                elif int(cell.get("s", 0)) in dates:
                    value = _EPOCH + dt.timedelta(days=float(raw))
                else:
                    value = float(raw)
                place = _column(cell.get("r")) if cell.get("r") else len(values)
                values += [None] * (place + 1 - len(values))
                values[place] = value
            yield values


def _type(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return "boolean"
    if kinds == {float}:
        return "bigint" if all(v.is_integer() for v in values if v is not None) else "double"
    if kinds == {dt.datetime}:
        midnight = all(v.time() == dt.time() for v in values if v is not None)
        return "date" if midnight else "timestamp_ntz"
    return "string"


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = list(_cells(content))
            names = [str(n) for n in rows[0]] if rows else []
            columns = [[r[i] if i < len(r) else None for r in rows[1:]] for i in range(len(names))]
            yield pd.DataFrame({"place": range(len(names)), "name": names, "type": [_type(c) for c in columns]})


def _fit(value, kind: str):
    if value is None:
        return None
    if kind == "string":
        return f"{value:g}" if isinstance(value, float) else str(value)
    if kind == "date":
        return value.date()
    return int(value) if kind == "bigint" else value


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    books = spark.read.format("binaryFile").load(path).select("content")
    found = (
        books.mapInPandas(_layouts, "place int, name string, type string")
        .groupBy("place", "name").agg(F.collect_set("type").alias("types")).orderBy("place").take(16_384)
    )
    if not found:
        raise InvalidInput("the workbook has no columns to import")
    if len({r["place"] for r in found}) != len(found):
        raise InvalidInput("the workbooks do not share one header")
    kinds = []
    for row in found:
        types = set(row["types"])
        kinds.append(types.pop() if len(types) == 1 else "double" if types == {"bigint", "double"} else "string")
    names = [r["name"] for r in found]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = list(_cells(content))[1:]
                yield pd.DataFrame({
                    name: pd.Series([_fit(line[i] if i < len(line) else None, kind) for line in lines], dtype=object)
                    for i, (name, kind) in enumerate(zip(names, kinds))})

    return books.mapInPandas(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
