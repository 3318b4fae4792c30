"""Nested codebooks in XML, whatever the namespace and depth."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source string, preorder int, parent_preorder int, depth int, name string, definition string, color string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def rows_of(source: str, xml: str) -> list[tuple]:
    """One row for each Code element in pre-order, with the number of its parent."""
    out: list[tuple] = []
    todo = [(e, None, 0) for e in reversed(ElementTree.fromstring(xml).findall("./*"))]
    root = ElementTree.fromstring(xml)
    todo = [(root, None, 0)]
    while todo:
        e, parent, depth = todo.pop()
        here, below = parent, depth
        if _local(e.tag) == "Code":
            text = next((c.text for c in e if _local(c.tag) == "Description" and c.text), None)
            here, below = len(out), depth + 1
            out.append((source, here, parent, depth, e.get("name") or "", (text or "").strip() or None, e.get("color")))
        todo += [(c, here, below) for c in reversed(list(e))]
    return out


def read_codebooks(spark: SparkSession, path: str) -> DataFrame:
    """Codes of all XML files of a path, one task a file."""
    src = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return parse_codebooks(src)


def parse_codebooks(src: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for s, v in zip(pdf.source, pdf.value) for r in rows_of(s, v)], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"parent_preorder": "Int32"})

    return src.mapInPandas(run, SCHEMA)


def import_codes(parsed: DataFrame, project_id: int, first_id: int = 1) -> DataFrame:
    """Code rows of one parsed codebook with ids in pre-order."""
    return parsed.select(
        (F.col("preorder") + first_id).cast("long").alias("id"), F.lit(project_id).cast("long").alias("project_id"), (F.col("parent_preorder") + first_id).cast("long").alias("parent_id"),
        "name", "definition", "color", F.col("preorder").alias("sort_order"),
    )
