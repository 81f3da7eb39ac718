"""Journals from workbook files (``.xlsx``): cells as rows, parsed on the executors, one workbook at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith import schemas as S
from kontolith.functions import patterns as P
from kontolith.sources.readers import ORDER, decoded_bookings, journal_bookings

STATE_SHEET = "_Daten"
CELLS = "path string, sheet string, sheet_no int, row_no int, cells array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """``(sheet, sheet number, row number, cells)`` of a workbook; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        for no, sheet in enumerate(sheets):
            rel = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
            place = targets[rel].lstrip("/")
            place = place if place.startswith("xl/") else f"xl/{place}"
            row_no = 0
            for _, row in ElementTree.iterparse(io.BytesIO(z.read(place))):
                if _local(row.tag) != "row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text or None)
                yield sheet.get("name"), no, row_no, cells
                row_no += 1
                row.clear()


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """All cells of the workbooks under ``path``; a file that is no workbook has no rows."""

    def run(frames):
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(file, *r) for r in workbook_rows(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_no", "row_no", "cells"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, CELLS)


def _place(wanted: list[str]) -> Column:
    """Number, from 1, of the first column of ``head`` that has one of the names; null if none has."""
    return F.array_min(F.transform("head", lambda h, i: F.when(h.isin(*wanted), i + 1)))


def _as_table(cells: DataFrame, fields: list[str], names: dict[str, str]) -> DataFrame:
    """Rows below each sheet's head line, with the columns whose head stands for one of ``fields`` (the first that does)."""
    head = cells.where("row_no = 0").select("path", "sheet", F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))).alias("head"))
    body = cells.where("row_no > 0").join(head, ["path", "sheet"])
    cols = []
    for f in fields:
        at = _place([k for k, v in names.items() if v == f])
        cols.append(F.when(at.isNotNull(), F.try_element_at("cells", at)).alias(f))
    return body.select(F.struct("path", "sheet_no", "row_no").alias(ORDER), *cols)


def _dated(rows: DataFrame) -> DataFrame:
    """Day numbers of workbooks as dates."""
    number = F.col("datum").try_cast("double")
    return rows.withColumn("datum", F.when(number.isNotNull() & (number > 366), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")).cast("string")).otherwise(F.col("datum")))


def read_journal_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Bookings of journals in workbooks: of each file its stored rows if it has that sheet, else its journal sheets, else its first sheet; with their rows' places as ``_order``."""
    cells = read_workbooks(spark, path, pattern)
    kinds = cells.select("path", "sheet", "sheet_no").distinct().withColumn("kind", F.when(F.col("sheet") == STATE_SHEET, 0).when(F.startswith(F.lower("sheet"), F.lit("journal")), 1).when(F.col("sheet_no") == 0, 2))
    best = kinds.where("kind is not null").groupBy("path").agg(F.min("kind").alias("kind"))
    chosen = cells.join(kinds.join(best, ["path", "kind"]).select("path", "sheet", "kind"), ["path", "sheet"])
    own = [f.name for f in S.BOOKING]
    stored = decoded_bookings(_dated(_as_table(chosen.where("kind = 0"), own, {n: n for n in own})).select(ORDER, *own), [F.col(ORDER)])
    fields = list(dict.fromkeys(P.JOURNAL_COLUMNS.values()))
    foreign = journal_bookings(_dated(_as_table(chosen.where("kind > 0"), fields, P.JOURNAL_COLUMNS)).select(ORDER, *fields))
    return stored.unionByName(foreign)
