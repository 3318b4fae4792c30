"""Markdown files with front matter, and vaults of them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Keys that become columns of their own; all others stay in the map of extras.
FIELDS = ("title", "author", "year", "era", "language")
_FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)"


def front_matter(text: Column) -> tuple[Column, Column]:
    """(metadata map, body) of a text: scalar "key: value" lines between --- lines.

    Without front matter, or with one that is not closed, the map is empty and the body is the whole text.
    Headings of the form "# ..." and blank lines at the start of the body are left out.
    """
    t = F.coalesce(text, F.lit(""))
    has = t.rlike(_FRONT)
    block = F.when(has, F.regexp_extract(t, _FRONT, 1)).otherwise("")
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:\s*\S"))
    unquote = lambda v: F.regexp_replace(T.strip(v), r"^(['\"])(.*)\1$", "$2")
    entries = F.transform(pairs, lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("key"), unquote(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    meta = F.map_from_entries(F.filter(entries, lambda e: (e["value"] != "null") & (e["value"] != "~")))
    body = F.when(has, F.regexp_replace(F.regexp_replace(t, _FRONT, ""), r"^(?:[ \t]*(?:#[^\n]*)?\r?\n)+", "")).otherwise(t)
    return meta, body


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """All .md files below a path: file_path, title, author, year, era, language, extras, body, links.

    The title is that of the front matter, else the file's stem.
    """
    src = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("file_path", F.input_file_name())
    return parse_markdown(src)


def parse_markdown(src: DataFrame) -> DataFrame:
    meta, body = front_matter(F.col("value"))
    stem = F.url_decode(F.regexp_extract(F.col("file_path"), r"([^/]+?)(?:\.md)?$", 1))
    d = src.withColumn("_m", meta).withColumn("body", body)
    return d.select(
        "file_path", F.coalesce(F.col("_m")["title"], stem).alias("title"), F.col("_m")["author"].alias("author"), F.col("_m")["year"].try_cast("int").alias("year"), F.col("_m")["era"].alias("era"),
        F.col("_m")["language"].alias("language"), F.map_filter("_m", lambda k, v: ~k.isin(*FIELDS)).alias("extras"), "body", T.wikilinks(F.col("body")).alias("links"),
    ).orderBy("file_path")


def is_vault(path: str) -> bool:
    """Whether a directory looks like a vault: it has a .obsidian directory or any .md file."""
    if os.path.isdir(os.path.join(path, ".obsidian")):
        return True
    return any(f.endswith(".md") for _, _, files in os.walk(path) for f in files)
