"""Co-occurrence of codings, cross-tables, series and networks.

Spans are compared by an equi-join on document and position bucket with the interval test left over, so a
document with very many segments is spread over its buckets. Equal spans of a code are counted before they
are joined, and the counts multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

BUCKET = 512
SCOPES = ("overlap", "distance", "paragraph")
DIMENSIONS = ("year", "author", "era", "language")


def _spans(segments: DataFrame, codes: DataFrame) -> DataFrame:
    """Segments with the project of their code, equal spans of a code counted."""
    c = codes.select(F.col("id").alias("_c"), F.col("project_id").alias("project"))
    s = segments.where("char_end > char_start and document_id is not null and char_start is not null")
    # counted before the join, so a hot code is small by then
    s = s.groupBy("document_id", "code_id", "char_start", "char_end").agg(F.count("*").alias("n"))
    return s.join(c, F.col("code_id") == F.col("_c")).drop("_c")


def pair_matrix(segments: DataFrame, codes: DataFrame, scope: str = "overlap", distance: int = 20, documents: DataFrame | None = None) -> DataFrame:
    """(project, code_a, code_b, n): pairs of segments of different codes of a project that meet in a document.

    overlap: the spans share a character; distance: at most so many characters lie between; paragraph: both
    start in one paragraph (needs ``documents``). An unknown scope is an error.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    s = _spans(segments, codes)
    if scope == "paragraph":
        starts = documents.select(F.col("id").alias("_d"), T.paragraph_starts(F.col("body")).alias("_starts"))
        s = s.join(starts, F.col("document_id") == F.col("_d"))
        s = s.groupBy("project", "document_id", T.paragraph_index(F.col("_starts"), F.col("char_start")).alias("par"), "code_id").agg(F.sum("n").alias("n"))
        b = s.select(F.col("project").alias("p2"), F.col("document_id").alias("d2"), F.col("par").alias("par2"), F.col("code_id").alias("c2"), F.col("n").alias("n2"))
        met = s.join(b, (F.col("project") == F.col("p2")) & (F.col("document_id") == F.col("d2")) & (F.col("par") == F.col("par2")) & (F.col("code_id") < F.col("c2")))
        return met.groupBy("project", F.col("code_id").alias("code_a"), F.col("c2").alias("code_b")).agg(F.sum(F.col("n") * F.col("n2")).alias("n"))
    reach = distance if scope == "distance" else -1
    last = F.col("char_end") + reach  # last position at which another span may start
    s = s.withColumn("last", last).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("char_start") / BUCKET), F.floor(last / BUCKET))))
    b = s.select(
        F.col("project").alias("p2"), F.col("document_id").alias("d2"), F.col("code_id").alias("c2"), F.col("char_start").alias("s2"), F.col("last").alias("l2"), F.col("n").alias("n2"), F.col("bucket").alias("b2")
    )
    later = F.greatest("char_start", "s2")
    met = s.join(
        b,
        (F.col("project") == F.col("p2")) & (F.col("document_id") == F.col("d2")) & (F.col("bucket") == F.col("b2")) & (F.col("code_id") < F.col("c2"))
        & (later <= F.least("last", "l2")) & (F.col("bucket") == F.floor(later / BUCKET)),
    )
    return met.groupBy("project", F.col("code_id").alias("code_a"), F.col("c2").alias("code_b")).agg(F.sum(F.col("n") * F.col("n2")).alias("n"))


def with_diagonal(matrix: DataFrame, segments: DataFrame, codes: DataFrame) -> DataFrame:
    """Both directions of a pair matrix, and the frequency of each code on the diagonal."""
    c = codes.select(F.col("id").alias("_c"), F.col("project_id").alias("project"))
    f = segments.groupBy("code_id").agg(F.count("*").alias("n")).join(c, F.col("code_id") == F.col("_c"))
    turned = matrix.select("project", F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "n")
    return matrix.unionByName(turned).unionByName(f.select("project", F.col("code_id").alias("code_a"), F.col("code_id").alias("code_b"), "n"))


def crosstab(segments: DataFrame, codes: DataFrame, documents: DataFrame, dimension: str) -> DataFrame:
    """(code_id, name, value, n) of codes against year, author, era or language; null values drop out."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension: {dimension}")
    d = documents.select(F.col("id").alias("_d"), F.col(dimension).cast("string").alias("value")).where("value is not null")
    c = codes.select(F.col("id").alias("_c"), "name")
    per = segments.groupBy("document_id", "code_id").agg(F.count("*").alias("k"))
    n = per.join(d, F.col("document_id") == F.col("_d")).groupBy("code_id", "value").agg(F.sum("k").alias("n"))
    return n.join(c, F.col("code_id") == F.col("_c")).select("code_id", "name", "value", "n")


def crosstab_wide(table: DataFrame, values: list[str]) -> DataFrame:
    """A cross-table with one column for each of the given values, 0 where nothing was counted."""
    return table.groupBy("code_id", "name").pivot("value", values).agg(F.sum("n")).na.fill(0)


def timeseries(segments: DataFrame, documents: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """(code_id, year, n); an empty list of codes is no filter, documents without a year drop out."""
    s = segments.where(F.col("code_id").isin(codes)) if codes else segments
    d = documents.where("year is not null").select(F.col("id").alias("_d"), "year")
    per = s.groupBy("document_id", "code_id").agg(F.count("*").alias("k"))
    return per.join(d, F.col("document_id") == F.col("_d")).groupBy("code_id", "year").agg(F.sum("k").alias("n"))


def graph_nodes(segments: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes that have segments: id, label, value, color."""
    f = segments.groupBy("code_id").agg(F.count("*").alias("n"))
    return codes.join(f, F.col("id") == F.col("code_id")).select("id", F.col("name").alias("label"), F.greatest("n", F.lit(1)).alias("value"), "color")


def graph_edges(matrix: DataFrame, relations: DataFrame | None = None, min_count: int = 1) -> DataFrame:
    """source, target, weight, relation: pairs of at least ``min_count`` and semantic relations."""
    e = matrix.where(F.col("n") >= min_count).select(F.col("code_a").alias("source"), F.col("code_b").alias("target"), F.col("n").cast("double").alias("weight"), F.lit("cooccurrence").alias("relation"))
    if relations is not None:
        e = e.unionByName(relations.select(F.col("code_a_id").alias("source"), F.col("code_b_id").alias("target"), F.col("weight").cast("double").alias("weight"), F.col("relation_type").alias("relation")))
    return e
