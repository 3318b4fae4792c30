"""Export tables as CSV: codes, segments, metadata, sentiment."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.coding import code_summary, quotes

TABLES = ("codes", "segments", "metadata", "sentiment")


def codes_table(codes: DataFrame, segments: DataFrame) -> DataFrame:
    return code_summary(codes, segments).select("id", "name", "parent_id", "definition", "frequency", "n_documents")


def segments_table(segments: DataFrame, documents: DataFrame, codes: DataFrame, coders: DataFrame) -> DataFrame:
    """Segments with title, code, coder (if known) and quoted text."""
    d = documents.select(F.col("id").alias("_t"), "title")
    c = codes.select(F.col("id").alias("_c"), F.col("name").alias("code"))
    k = coders.select(F.col("id").alias("_k"), F.col("name").alias("coder"))
    q = quotes(segments, documents).join(d, F.col("document_id") == F.col("_t")).join(c, F.col("code_id") == F.col("_c")).join(k, F.col("coder_id") == F.col("_k"), "left")
    return q.select("id", "document_id", "title", "code", "coder", "char_start", "char_end", "status", "quote")


def metadata_table(documents: DataFrame) -> DataFrame:
    return documents.select("id", "title", "author", "year", "era", "language", "script", "ocr_engine", "confidence")


def sentiment_table(scores: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(F.col("id").alias("_d"), "title")
    return scores.join(d, F.col("document_id") == F.col("_d")).select("document_id", "title", "unit", "char_start", "char_end", "polarity", "dictionary").orderBy("title", "char_start")


def write_csv(df: DataFrame, path: str) -> None:
    """A directory of CSV parts with header; the form for tables of any size."""
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)


def write_one_csv(df: DataFrame, path: str, bom: bool = False) -> int:
    """One CSV file with CRLF line ends, row by row through the driver; returns the number of rows."""
    n = 0
    with Path(path).open("w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_excel(tables: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet a table; needs openpyxl."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("openpyxl is not installed") from e
    book = Workbook(write_only=True)
    for name, df in tables.items():
        sheet = book.create_sheet(name)
        sheet.append(df.columns)
        for row in df.toLocalIterator():
            sheet.append(list(row))
    book.save(path)


def write_records(df: DataFrame, path: str) -> None:
    """Exchange records as JSON lines."""
    df.write.mode("overwrite").json(path)
