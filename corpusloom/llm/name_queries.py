"""Problem 2: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.names import resolve_names, spelling_pairs
from corpusloom.llm.queries import llm
from corpusloom.session import table


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of an author field and every author of an entry."""
    a = table(spark, sf_dir, "qda_document").select(F.explode(F.split("author", ";")).alias("name"))
    z = table(spark, sf_dir, "zotero_entry").select(F.explode("authors").alias("name"))
    return a.unionByName(z)


@llm.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(resolve_names(spellings(spark, sf_dir)))


@llm.query("p2_identities")
def p2_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its identity and the number of the identity's spellings."""
    r = resolve_names(spellings(spark, sf_dir))
    n = r.groupBy(F.col("identity").alias("_i")).agg(F.count("*").alias("n_spellings"))
    return r.join(n, F.col("identity") == F.col("_i")).select("name", "identity", "n_spellings")
