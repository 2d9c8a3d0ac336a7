"""Tabular files as rows of trimmed strings; empty cells are null."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text


ARRIVAL = "_arrival"


def arrival() -> Column:
    """Where a row stands in its source, for frames straight from Spark's file readers: (file, block, record), sortable.

    A block of a file is read by one task in order, so the counter says the order within it, whatever task reads it; blocks and files are told apart by name and start.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("record")).alias(ARRIVAL)


def arrived(rows: DataFrame) -> DataFrame:
    """rows of a file reader with _arrival; ask before anything is joined, grouped or dealt anew."""
    return rows.select("*", arrival())


def read_csv(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Header row first, every column a string; cells beyond the header are dropped. numbered: with _arrival."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[clean_text(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in rows.columns], *([arrival()] if numbered else []))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet, by row, as its cached values."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{_NS}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = cell.find(f"{_NS}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_NS}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                cells[at - 1] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """file, row_number, cells (a map by header) of each row that isn't empty; files are read in parallel, each by one task."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                header, *body = sheet_rows(content) or [[]]
                header = [str(h).strip() if h else "" for h in header]
                out = [{h: c.strip() for h, c in zip(header, r, strict=False) if h and c and c.strip()} for r in body]
                kept = [(name, i, r) for i, r in enumerate(out, 1) if r]
                yield pd.DataFrame(kept, columns=["file", "row_number", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, row_number int, cells map<string,string>")


READERS = {"csv": read_csv, "xlsx": read_xlsx}


def read_tabular(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unsupported file type {kind}")
    return READERS[kind](spark, path)


def decoded(content: bytes) -> str:
    """UTF-8 (with or without its mark), else GB18030, else UTF-8 without what is broken."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "ignore")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text, content_hash of each file."""

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[decoded(c) for c in frame["content"]])[["file", "text", "content_hash"]]

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.sha2("content", 256).alias("content_hash"))
    return files.mapInPandas(texts, "file string, text string, content_hash string")


def read_json_lines(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """Blank lines are skipped; a line that is no object of the schema is an error. numbered: with _arrival."""
    lines = spark.read.text(path).select("value", *([arrival()] if numbered else [])).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), *lines.columns[1:]).select("r.*", *lines.columns[1:])
