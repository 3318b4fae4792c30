"""Library search: one lazily composed plan from a specification of filters and order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SORT_KEYS = ("id", "title", "author", "year", "era", "language", "confidence", "code_count")
#: Labels whose documents are searched by words; all others by characters.
WORD_LANGUAGES = ("en", "eng", "english")


@dataclass(frozen=True)
class SearchSpec:
    """What to look for; None is no filter. ``coded``: with (True) or without (False) segments."""

    query: str | None = None
    project_id: int | None = None
    language: str | None = None
    author: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    collection_id: int | None = None
    coded: bool | None = None
    order_by: str = "id"
    descending: bool = False


def matches(query: str) -> Column:
    """Whether title or body holds the query.

    Below three characters a LIKE that folds ASCII only; otherwise, by the document's language label, a
    phrase of words without accents, or a case-folded run of characters.
    """
    q = query.strip()
    if len(q) < 3:
        return T.like_ascii(F.coalesce("title", F.lit("")), q) | T.like_ascii(F.coalesce("body", F.lit("")), q)
    words = T.contains_phrase(F.col("title"), q) | T.contains_phrase(F.col("body"), q)
    chars = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(q))) | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lower(F.lit(q)))
    return F.when(F.coalesce(F.col("language").isin(*WORD_LANGUAGES), F.lit(False)), words).otherwise(chars)


def search(documents: DataFrame, segments: DataFrame, spec: SearchSpec, members: DataFrame | None = None) -> DataFrame:
    """Documents that meet ``spec``: id, title, author, year, era, language, confidence, code_count.

    Filters come before the join with the pre-aggregated segment counts, and the body is read only where a
    query needs it. An unknown sort key means id; nulls sort first ascending and last descending; ids break
    ties. ``members`` has document_id and collection_id.
    """
    df = documents
    if spec.project_id is not None:
        df = df.where(F.col("project_id") == spec.project_id)
    if spec.language is not None:
        df = df.where(F.col("language") == spec.language)
    if spec.author is not None:
        df = df.where(T.like_ascii(F.col("author"), spec.author))
    if spec.year_min is not None:
        df = df.where(F.col("year") >= spec.year_min)
    if spec.year_max is not None:
        df = df.where(F.col("year") <= spec.year_max)
    if spec.query is not None and spec.query.strip():
        df = df.where(matches(spec.query))
    if spec.collection_id is not None and members is not None:
        inside = members.where(F.col("collection_id") == spec.collection_id).select(F.col("document_id").alias("_m"))
        df = df.join(inside, F.col("id") == F.col("_m"), "left_semi")
    counts = segments.groupBy(F.col("document_id").alias("_d")).agg(F.count("*").alias("n"))
    out = df.select("id", "title", "author", "year", "era", "language", "confidence")
    out = out.join(counts, F.col("id") == F.col("_d"), "left").withColumn("code_count", F.coalesce("n", F.lit(0))).drop("_d", "n")
    if spec.coded is not None:
        out = out.where((F.col("code_count") > 0) == F.lit(spec.coded))
    key = F.col(spec.order_by if spec.order_by in SORT_KEYS else "id")
    return out.orderBy(key.desc() if spec.descending else key.asc(), F.col("id").asc())


def collection_sizes(collections: DataFrame, members: DataFrame) -> DataFrame:
    """collection_id and n, the documents of each collection, 0 for an empty one. ``members``: document_id, collection_id."""
    n = members.where("document_id is not null").select("document_id", "collection_id").distinct().groupBy(F.col("collection_id").alias("_c")).agg(F.count("*").alias("n"))
    return collections.select(F.col("id").alias("collection_id")).distinct().join(n, F.col("collection_id") == F.col("_c"), "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"))


def document_collections(members: DataFrame, collections: DataFrame) -> DataFrame:
    """document_id with the id and name of each collection that it is in."""
    c = collections.select(F.col("id").alias("_c"), "name")
    return members.select("document_id", "collection_id").distinct().join(c, F.col("collection_id") == F.col("_c")).select("document_id", "collection_id", "name")
