"""Markdown notes and vaults: the text of each note is a column, written by the tasks that hold it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.coding import quotes

# Order of the front matter's keys.
KEY_ORDER = ("title", "author", "year", "era", "language", "script", "source_image", "ocr_engine", "confidence", "tags")


def front_matter(values: dict[str, Column], extras: Column | None = None) -> Column:
    """Front matter of the given values in the fixed order, extras behind, nulls left out."""
    lines = [F.when(values[k].isNotNull(), F.concat(F.lit(f"{k}: "), values[k].cast("string"))) for k in KEY_ORDER if k in values]
    parts = F.array_compact(F.array(*lines)) if lines else F.expr("cast(array() as array<string>)")
    if extras is not None:
        more = F.transform(F.array_sort(F.map_entries(F.coalesce(extras, F.expr("cast(map() as map<string,string>)")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        parts = F.concat(parts, F.filter(more, lambda x: x.isNotNull()))
    return F.concat(F.lit("---\n"), F.array_join(F.concat(parts, F.array(F.lit("---"))), "\n"), F.lit("\n"))


def markdown_text(documents: DataFrame) -> DataFrame:
    """(id, name, text): documents as notes with front matter, a heading and the body."""
    cols = {k: F.col(k) for k in KEY_ORDER if k in documents.columns}
    extras = F.from_json("metadata_json", "map<string,string>") if "metadata_json" in documents.columns else None
    return documents.select("id", T.safe_name(F.col("title")).alias("name"), F.concat(front_matter(cols, extras), F.lit("\n# 本文\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def vault_notes(documents: DataFrame, segments: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, name, text): notes with tags of the codes used and a callout for each coding, in order of position."""
    c = codes.select(F.col("id").alias("_c"), F.col("name").alias("code"))
    q = quotes(segments, documents).join(c, F.col("code_id") == F.col("_c"))
    callout = F.concat(F.lit("> [!quote] "), F.col("code"), F.lit("\n> "), F.replace(F.col("quote"), F.lit("\n"), F.lit("\n> ")))
    per = q.select("document_id", "char_start", "id", "code", callout.alias("callout")).groupBy(F.col("document_id").alias("_d")).agg(
        F.array_sort(F.collect_set(F.regexp_replace("code", r"\s+", "_"))).alias("tags"), F.transform(F.sort_array(F.collect_list(F.struct("char_start", "id", "callout"))), lambda x: x["callout"]).alias("callouts")
    )
    d = documents.join(per, F.col("id") == F.col("_d"), "left")
    cols = {k: F.col(k) for k in KEY_ORDER if k in documents.columns} | {"tags": F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")))}
    body = F.concat(front_matter(cols), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.array_join("callouts", "\n\n"), F.lit("\n")), F.lit("")))
    return d.select("id", T.safe_name(F.col("title")).alias("name"), body.alias("text"))


def relation_note(relations: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines "- [[a]] type [[b]]" of semantic relations, by id."""
    a = codes.select(F.col("id").alias("_a"), F.col("name").alias("a"))
    b = codes.select(F.col("id").alias("_b"), F.col("name").alias("b"))
    r = relations.join(a, F.col("code_a_id") == F.col("_a")).join(b, F.col("code_b_id") == F.col("_b"))
    return r.select("id", F.format_string("- [[%s]] %s [[%s]]", "a", "relation_type", "b").alias("line"))


def write_notes(notes: DataFrame, directory: str) -> None:
    """One file a note in a directory all executors share; notes of equal names get their id behind it."""

    def save(rows) -> None:
        os.makedirs(directory, exist_ok=True)
        for r in rows:
            with open(os.path.join(directory, f"{r.name}.md"), "w", encoding="utf-8") as f:
                f.write(r.text)

    from pyspark.sql import Window

    twice = F.count("*").over(Window.partitionBy("name")) > 1
    notes.withColumn("name", F.when(twice, F.concat("name", F.lit(" "), F.col("id").cast("string"))).otherwise(F.col("name"))).foreachPartition(save)
