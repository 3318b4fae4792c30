"""Codings: enriched segments, point lookup, display layers, frequencies, examples, suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import cut, spread


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Segments delivered several times count once."""
    return segments.dropDuplicates(["id"])


def enrich(segments: DataFrame, codes: DataFrame, coders: DataFrame) -> DataFrame:
    """Segments with code name and colour and, if known, the coder's name."""
    c = codes.select(F.col("id").alias("_c"), F.col("name").alias("code_name"), F.col("color").alias("code_color"))
    k = coders.select(F.col("id").alias("_k"), F.col("name").alias("coder_name"))
    return segments.join(c, F.col("code_id") == F.col("_c")).join(k, F.col("coder_id") == F.col("_k"), "left").drop("_c", "_k")


def codings_at(segments: DataFrame, offset: int | Column) -> DataFrame:
    """Segments whose half-open span holds the offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return segments.where((F.col("char_start") <= at) & (at < F.col("char_end")))


def quotes(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with the quoted text of their document."""
    d = documents.select(F.col("id").alias("_d"), "body")
    return segments.join(d, F.col("document_id") == F.col("_d")).withColumn("quote", F.expr("substring(body, char_start + 1, char_end - char_start)")).drop("_d", "body")


#: Segments of the runs that one call to Python takes, on average.
LAYER_ROWS = 20_000


def layers(segments: DataFrame) -> DataFrame:
    """(id, document_id, layer): overlapping segments of a document on different layers, as few as possible.

    Segments are taken by start, end and id; a layer that has become free is used again, the earliest first.
    A document's segments are spread by runs: where no segment is open a new run starts, so a document with
    very many segments is still cut into independent pieces.
    """
    by_doc = Window.partitionBy("document_id").orderBy("char_start", "char_end", "id")
    seen = F.max("char_end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    cutted = segments.select("id", "document_id", "char_start", "char_end").withColumn("fresh", F.when(seen.isNull() | (seen <= F.col("char_start")), 1).otherwise(0))
    runs = cutted.withColumn("run", F.sum("fresh").over(by_doc))

    # many runs at once go to Python, as most are short
    many = F.ceil(F.count("*") / LAYER_ROWS).cast("int")
    runs = cut(runs)
    buckets = max(1, runs.agg(many).first()[0] or 1)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values(["document_id", "run", "char_start", "char_end", "id"], kind="stable")
        free: list[tuple[int, int]] = []
        out, top, was = [], 0, None
        for *of, start, end in zip(pdf.document_id.tolist(), pdf.run.tolist(), pdf.char_start.tolist(), pdf.char_end.tolist()):
            if of != was:
                free, top, was = [], 0, of
            if free and free[0][0] <= start:
                layer = heapq.heappop(free)[1]
            else:
                layer, top = top, top + 1
            out.append(layer)
            heapq.heappush(free, (end, layer))
        return pdf[["id", "document_id"]].assign(layer=out)

    bucketed = runs.withColumn("bucket", F.pmod(F.xxhash64("document_id", "run"), F.lit(buckets)).cast("int"))
    return spread(bucketed, "bucket").groupBy("bucket").applyInPandas(assign, "id long, document_id long, layer int")


def in_order(segments: DataFrame) -> DataFrame:
    """Segments with ``place``, counted from 1 in each document by start, end and id."""
    w = Window.partitionBy("document_id").orderBy("char_start", "char_end", "id")
    return segments.withColumn("place", F.row_number().over(w).cast("long"))


def code_frequency(segments: DataFrame) -> DataFrame:
    """Segments per code."""
    return segments.groupBy("code_id").agg(F.count("*").alias("n_segments"))


def code_summary(codes: DataFrame, segments: DataFrame) -> DataFrame:
    """Each code with its segments and documents; codes without any have 0."""
    n = segments.groupBy(F.col("code_id").alias("_c")).agg(F.count("*").alias("f"), F.countDistinct("document_id").alias("d"))
    return codes.join(n, F.col("id") == F.col("_c"), "left").select(
        "id", "project_id", "parent_id", "name", "definition", F.coalesce("f", F.lit(0)).alias("frequency"), F.coalesce("d", F.lit(0)).alias("n_documents")
    )


def examples(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Per code its quoted texts in the order of segment ids; empty quotes are left out."""
    q = quotes(segments, documents).where(F.col("quote") != "")
    return q.groupBy("code_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "quote"))), lambda x: x["quote"]).alias("quotes"))


def first_examples(segments: DataFrame, documents: DataFrame, chars: int = 80) -> DataFrame:
    """Per code the start of its first quote that is not empty: code_id, example."""
    q = quotes(segments, documents).where(F.col("quote") != "")
    return q.groupBy("code_id").agg(F.min_by(F.substring("quote", 1, chars), "id").alias("example"))


def gram_vectors(texts: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """Sparse vectors (key, gram, w) of character n-gram counts."""
    return texts.select(key, F.explode(T.ngrams(F.col(text), n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").cast("double").alias("w"))


def centroids(vectors: DataFrame, owner: str, key: str) -> DataFrame:
    """Mean vector (owner, gram, w) of the vectors of each owner."""
    n = vectors.select(owner, key).distinct().groupBy(F.col(owner).alias("_o")).agg(F.count("*").alias("_n"))
    total = vectors.groupBy(owner, "gram").agg(F.sum("w").alias("w"))
    return total.join(n, F.col(owner) == F.col("_o")).select(owner, "gram", (F.col("w") / F.col("_n")).alias("w"))


def cosine(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(left_key, right_key, score) of all pairs of sparse vectors with a gram in common.

    Shared grams meet in an equi-join and are added up; the squared lengths come by one aggregation a side.
    """
    ll = left.groupBy(F.col(left_key).alias("_l")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    rr = right.groupBy(F.col(right_key).alias("_r")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    a, b = left.select(left_key, "gram", F.col("w").alias("a")), right.select(right_key, F.col("gram").alias("g2"), F.col("w").alias("b"))
    dot = a.join(b, F.col("gram") == F.col("g2")).groupBy(left_key, right_key).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    return dot.join(ll, F.col(left_key) == F.col("_l")).join(rr, F.col(right_key) == F.col("_r")).select(left_key, right_key, F.coalesce(F.try_divide("dot", F.col("ln") * F.col("rn")), F.lit(0.0)).alias("score"))


def top_suggestions(scores: DataFrame, key: str, code: str = "code_id", k: int = 3, min_score: float = 0.05) -> DataFrame:
    """The k best codes of each key with at least the least score; equal scores by code."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), F.asc(code))
    return scores.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suggest_by_embedding(df: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    """(key, code_id, score): cosine of each dense vector with each label's mean vector.

    Vectors are taken apart by dimension, so the dense case is the sparse one with dimensions for grams.
    """
    pos = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(label).cast("long").alias("code_id"), F.posexplode(vector).alias("gram", "x"))
    mean = pos.groupBy("code_id", "gram").agg(F.avg(F.col("x").cast("double")).alias("w"))
    return cosine(df.select(key, F.posexplode(vector).alias("gram", "x")).select(key, "gram", F.col("x").cast("double").alias("w")), key, mean, "code_id")


def iter_rows(df: DataFrame) -> Iterator:
    """Rows one partition at a time, for sinks on the driver."""
    return df.toLocalIterator()
