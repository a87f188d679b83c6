"""Readers: parquet with pinned hashes, string CSV, workbook sheets, page files and settings."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator, Mapping
from io import BytesIO
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.contracts import ContractError
from seekgrain.operators.dense import is_finite_vector

SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, n_bytes) of every file; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def read_pinned(spark: SparkSession, path: str, expected: Mapping[str, str], schema=None) -> DataFrame:
    """Read parquet only when each file carries the hash its manifest entry states."""
    wanted = spark.createDataFrame(sorted(expected.items()), "name string, expected string")
    found = file_hashes(spark, path, "*.parquet").withColumn("name", F.substring_index("path", "/", -1))
    wrong = found.join(wanted, "name", "full").filter(
        F.col("sha256").isNull() | F.col("expected").isNull() | (F.col("sha256") != F.col("expected"))
    )
    if not wrong.isEmpty():
        raise ContractError("artifact does not match its manifest hash")
    return read_parquet(spark, path, schema)


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as strings, missing values as the empty string, no value coercion, no BOM.

    Quoted line breaks need ``multi_line``, which makes every file one task.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    renamed = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    return renamed.na.fill("")


def _cell_text(cell, shared: list[str]) -> tuple[str, bool]:
    formula = cell.find(f"{SHEET_NS}f") is not None
    kind, value = cell.get("t"), cell.find(f"{SHEET_NS}v")
    if kind == "inlineStr":
        return "".join(node.text or "" for node in cell.iter(f"{SHEET_NS}t")), formula
    text = "" if value is None else value.text or ""
    return (shared[int(text)] if kind == "s" and text else text), formula


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def workbook_rows(content: bytes, sheet: int = 1) -> tuple[list[list[str]], int]:
    """Rows of one sheet as text and the number of formula cells; blank rows are dropped."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET_NS}t")) for item in root]
        root = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows, formulas = [], 0
    for row in root.iter(f"{SHEET_NS}row"):
        cells: list[str] = []
        for cell in row.iter(f"{SHEET_NS}c"):
            text, formula = _cell_text(cell, shared)
            at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
            cells.extend([""] * (at - len(cells)))
            cells.append(text)
            formulas += formula
        if any(cell.strip() for cell in cells):
            rows.append(cells)
    return rows, formulas


def read_workbooks(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row_number, cells, n_formulas) of every workbook under ``path``; the first row is the
    header and short rows are padded to it."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, formulas = workbook_rows(content, sheet)
                width = len(rows[0]) if rows else 0
                padded = [row + [""] * (width - len(row)) for row in rows]
                yield pd.DataFrame(
                    {"path": name, "row_number": range(len(rows)), "cells": padded, "n_formulas": formulas}
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row_number long, cells array<string>, n_formulas long")


def sheet_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one workbook layout as named columns, without the header."""
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(columns)]
    return rows.filter("row_number > 0").select("path", "row_number", *cells)


def read_pdf_pages(spark: SparkSession, path: str, ocr=None, minimum_characters: int = 80) -> DataFrame:
    """(path, page_number, extraction_method, ocr_confidence, raw_text) of every page.

    Needs the optional ``pypdf`` on the executors. ``ocr(content, page) -> (text, confidences)`` is
    called for pages without enough digital text.
    """

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = []
                for number, page in enumerate(PdfReader(BytesIO(content)).pages, start=1):
                    text, method, confidence = page.extract_text() or "", "digital_text", None
                    if len(text.strip()) < minimum_characters and ocr is not None:
                        text, scores = ocr(content, number)
                        kept = [s for s in scores if s >= 0]
                        method, confidence = "tesseract_ocr", sum(kept) / len(kept) if kept else None
                    rows.append((name, number, method, confidence, text))
                yield pd.DataFrame(
                    rows, columns=["path", "page_number", "extraction_method", "ocr_confidence", "raw_text"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(
        pages, "path string, page_number long, extraction_method string, ocr_confidence double, raw_text string"
    )


def upload_problem(name: str, n_bytes: int, n_pages: int, megabytes: int = 5, pages: int = 3) -> str | None:
    """Why an uploaded preview is refused, else None."""
    if PurePosixPath(name).suffix.lower() != ".pdf":
        return "only .pdf files can be previewed"
    if n_bytes > megabytes * 1024 * 1024:
        return f"larger than {megabytes} MB"
    return f"more than {pages} pages" if n_pages > pages else None


def resolve_evidence_files(spark: SparkSession, roots: list[str], prefix: str, sha256: str) -> DataFrame:
    """Files below the allowed roots named ``prefix__*`` whose content has the wanted hash."""
    if re.search(r"[\\/]|\.\.", prefix):
        raise ContractError("an evidence name may not leave its folder")
    found = None
    for root in roots:
        part = file_hashes(spark, root, f"{prefix}__*")
        found = part if found is None else found.unionByName(part)
    return found.filter(F.col("sha256") == sha256)


def index_checks(postings: DataFrame, terms: DataFrame, doc_stats: DataFrame, key: str) -> DataFrame:
    """One row of integrity counts of a stored index; all zero when it is sound."""
    bad_postings = postings.filter((F.col("tf") <= 0) | F.col("term").isNull()).agg(F.count("*").alias("bad_postings"))
    unknown = postings.select(key).join(doc_stats.select(key), key, "left_anti").agg(F.count("*").alias("unknown_documents"))
    counted = postings.groupBy("term").agg(F.count("*").alias("n"))
    odd = terms.join(counted, "term", "full").agg(
        F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("df", F.lit(-1))).alias("wrong_frequencies"),
        F.count_if(F.col("idf").isNull() | F.isnan("idf")).alias("bad_weights"),
    )
    return odd.select(
        "*",
        F.lit(bad_postings.scalar()).alias("bad_postings"),
        F.lit(unknown.scalar()).alias("unknown_documents"),
    )


def vector_checks(vectors: DataFrame, vector: str) -> DataFrame:
    """Vectors that are not finite, of another width or not of unit length."""
    squares: Column = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    width = F.size(vector)
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.min(width).alias("smallest_width"),
        F.max(width).alias("largest_width"),
        F.count_if(~is_finite_vector(F.col(vector))).alias("n_not_finite"),
        F.count_if(F.abs(F.sqrt(squares) - 1) > 1e-3).alias("n_not_unit"),
    )


def read_settings(text: str, sections: tuple[str, ...], pinned: Mapping[str, object]) -> dict:
    """JSON settings with required sections and pinned values."""
    settings = json.loads(text)
    missing = [s for s in sections if s not in settings]
    if missing:
        raise ContractError(f"missing settings: {', '.join(missing)}")
    for dotted, value in pinned.items():
        node = settings
        for part in dotted.split("."):
            node = node.get(part) if isinstance(node, dict) else None
        if node != value:
            raise ContractError(f"{dotted} must be {value!r}")
    return settings
