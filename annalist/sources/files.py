"""Readers of single files that Spark has no reader for: SQLite databases and spreadsheets."""

from __future__ import annotations

import datetime as dt
import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, rows_per_part: int = 100_000) -> DataFrame:
    """The columns of the schema of a table, read by ranges of row ids, each by a read-only connection of its own.

    The path must be one that all executors share.
    """
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        top = db.execute(f"SELECT max(rowid) FROM {quoted(table)}").fetchone()[0] or 0
    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    names = [f.name for f in kind]
    parts = max(1, -(-top // rows_per_part))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    cursor = db.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(table)} WHERE rowid > ? AND rowid <= ?", (int(k) * rows_per_part, (int(k) + 1) * rows_per_part))
                    while got := cursor.fetchmany(10_000):
                        yield pd.DataFrame(got, columns=names, dtype=object)

    return spark.range(0, parts, 1, parts).mapInPandas(run, kind)


def _cell(cell, strings: list[str], dated: set[int]):
    """The value of a spreadsheet's cell: text, number, or date where its style says so."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    kind, value = cell.get("t"), cell.find(f"{ns}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{ns}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind in ("str", "b", "e"):
        return value.text
    if int(cell.get("s") or 0) in dated:
        return (dt.date(1899, 12, 30) + dt.timedelta(days=int(float(value.text)))).isoformat()
    return value.text


def sheet_rows(body: bytes) -> list[list[str | None]]:
    """The rows of a workbook's first sheet as texts; dates as YYYY-MM-DD."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = set(z.namelist())
        tree = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
        shared, styles, sheet = tree("xl/sharedStrings.xml"), tree("xl/styles.xml"), tree("xl/worksheets/sheet1.xml")
    strings = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in shared.findall(f"{ns}si")] if shared is not None else []
    dated: set[int] = set()
    if styles is not None:
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{ns}numFmt") if re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""))}
        formats = styles.find(f"{ns}cellXfs")
        dated = {i for i, x in enumerate(formats if formats is not None else []) if (n := int(x.get("numFmtId") or 0)) in own or 14 <= n <= 17 or n == 22}
    out = []
    for row in sheet.iter(f"{ns}row") if sheet is not None else ():
        cells: dict[int, str | None] = {}
        for i, c in enumerate(row.findall(f"{ns}c")):
            letters = re.match("[A-Z]+", c.get("r") or "")
            place = 0
            for x in letters[0] if letters else "":
                place = place * 26 + ord(x) - 64
            cells[place - 1 if letters else i] = _cell(c, strings, dated)
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of the first sheets of workbooks (a path or a pattern)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                got = sheet_rows(bytes(body))
                yield pd.DataFrame({"path": [name] * len(got), "row": range(len(got)), "cells": got})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")
