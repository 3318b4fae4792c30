"""Bibliographies in JSON: {"items": [...]} or an array in CSL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_CREATOR = "struct<lastName:string,firstName:string,family:string,given:string,name:string>"
ITEM = (
    "struct<citationKey:string,`citation-key`:string,id:string,key:string,title:string,creators:array<string>,author:array<string>,"
    "date:string,issued:string,year:string,language:string,publicationTitle:string,`container-title`:string>"
)


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files of a path: key, title, authors, year, language, source, raw."""
    return parse_bibliography(spark.read.text(path, wholetext=True))


def parse_bibliography(texts: DataFrame, col: str = "value") -> DataFrame:
    """Entries of JSON texts; nested values that the form leaves open are kept as JSON until they are read."""
    raw = F.coalesce(F.get_json_object(col, "$.items"), F.col(col))
    items = texts.select(F.explode(F.from_json(raw, "array<string>")).alias("raw"))
    g = lambda p: F.nullif(F.get_json_object("raw", p), F.lit(""))
    creators = F.from_json(F.coalesce(F.get_json_object("raw", "$.creators"), F.get_json_object("raw", "$.author")), "array<string>")
    # a creator is a string, or an object with last and first, or family and given, or one name
    last = lambda c: F.coalesce(F.get_json_object(c, "$.lastName"), F.get_json_object(c, "$.family"), F.lit(""))
    first = lambda c: F.coalesce(F.get_json_object(c, "$.firstName"), F.get_json_object(c, "$.given"), F.lit(""))
    joined = lambda c: T.strip(F.concat(last(c), F.when(first(c) == "", "").otherwise(F.concat(F.lit("　"), first(c)))))
    name = lambda c: F.when(~c.startswith("{"), c).otherwise(F.coalesce(F.nullif(joined(c), F.lit("")), F.get_json_object(c, "$.name")))
    when = F.coalesce(g("$.date"), g("$.issued"), g("$.year"))
    year = F.coalesce(T.year_of(F.get_json_object(when, "$.date-parts[0][0]")), when.try_cast("int"), T.year_of(when))
    return items.select(
        F.coalesce(g("$.citationKey"), g("$.citation-key"), g("$.id"), g("$.key"), F.lit("")).alias("key"), g("$.title").alias("title"),
        F.coalesce(F.filter(F.transform(creators, name), lambda n: n.isNotNull() & (n != "")), F.expr("cast(array() as array<string>)")).alias("authors"),
        year.alias("year"), g("$.language").alias("language"), F.coalesce(g("$.publicationTitle"), g("$.container-title")).alias("source"), "raw",
    )


def to_metadata(entries: DataFrame) -> DataFrame:
    """Document metadata of entries: authors joined by "; ", blank values null."""
    return entries.select(
        F.nullif("key", F.lit("")).alias("citation_key"), F.nullif("title", F.lit("")).alias("title"), F.nullif(F.array_join("authors", "; "), F.lit("")).alias("author"), F.nullif("year", F.lit(0)).alias("year"), "language", "source"
    )
