"""Problems 3 and 7: consensus of coders, codes that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.consensus import consensus, fit_competence, span_labels
from corpusloom.llm.pairs import surprising_pairs
from corpusloom.llm.queries import llm
from corpusloom.session import cut, lookup, table


#: A pair is surprising if the null gives so many documents or more with at most this chance (log10).
SURPRISING = -1.0


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "qda_code").select(F.col("id").alias("_code"), "project_id").dropna()
    return codes.groupBy("_code").agg(F.min("project_id").alias("project_id"))


def _unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cut(span_labels(table(spark, sf_dir, "qda_segment"), table(spark, sf_dir, "coding_unit")))
    return cut(lookup(labels, "code_id", _projects(spark, sf_dir), "_code").select("unit_id", "coder_id", "code_id", "project_id").where("project_id is not null"))


def _fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labels = _unit_labels(spark, sf_dir)
    return labels, *fit_competence(labels, space="project_id")


@llm.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, posterior, _ = _fit(spark, sf_dir)
    return consensus(labels, posterior, min_coders=3).select("unit_id", "code_id")


@llm.query("p3_consensus")
def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code per labelled unit with confidence, number of coders and agreement."""
    labels, posterior, _ = _fit(spark, sf_dir)
    return consensus(labels, posterior)


@llm.query(
    "p3_units",
    """SELECT u.unit_id, count(DISTINCT s.coder_id) AS n_coders FROM coding_unit u JOIN qda_segment s ON s.document_id = u.document_id AND s.char_start < u.char_end AND u.char_start < s.char_end AND s.char_end > s.char_start
JOIN (SELECT DISTINCT id FROM qda_code WHERE project_id IS NOT NULL) c ON c.id = s.code_id WHERE u.char_end > u.char_start GROUP BY 1""",
)
def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled unit with the number of its coders."""
    labels, posterior, _ = _fit(spark, sf_dir)
    return consensus(labels, posterior).select("unit_id", "n_coders")


@llm.query("p3_coders")
def p3_coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each coder: competence and number of labels."""
    return _fit(spark, sf_dir)[2]


def _code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = cut(table(spark, sf_dir, "qda_segment").select("document_id", "code_id").dropna().distinct())
    rows = lookup(used, "code_id", _projects(spark, sf_dir), "_code").where("project_id is not null")
    return surprising_pairs(rows, "project_id", "document_id", "code_id")


_USES = """
WITH code AS (SELECT id, min(project_id) AS project_id FROM qda_code WHERE project_id IS NOT NULL GROUP BY id),
uses AS (SELECT DISTINCT c.project_id AS g, s.document_id AS d, s.code_id AS c
         FROM qda_segment s JOIN code c ON c.id = s.code_id WHERE s.document_id IS NOT NULL),
na AS (SELECT g, c, count(*) AS n FROM uses GROUP BY g, c),
nd AS (SELECT g, count(DISTINCT d) AS n FROM uses GROUP BY g),
nab AS (SELECT x.g, x.c AS a, y.c AS b, count(*) AS n FROM uses x JOIN uses y ON x.g = y.g AND x.d = y.d AND x.c < y.c GROUP BY 1, 2, 3),
pair AS (SELECT p.g, p.a, p.b, p.n AS n_ab, a.n AS n_a, b.n AS n_b, nd.n AS n FROM nab p
         JOIN na a ON a.g = p.g AND a.c = p.a JOIN na b ON b.g = p.g AND b.c = p.b JOIN nd ON nd.g = p.g)
"""


@llm.query("p7_found", _USES + "SELECT a AS code_a_id, b AS code_b_id FROM pair WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose count is in the null's upper tail, then the exact bounds.

    The q-values of ``p7_surprise`` are no use here: five documents where two are expected, which the bounds
    ask for, are not rare among all pairs.
    """
    p = _code_pairs(spark, sf_dir).where(F.col("log10_p") <= SURPRISING)
    return p.where("n_ab >= 5 and n_ab * n >= 3 * n_a * n_b").select(F.col("a").alias("code_a_id"), F.col("b").alias("code_b_id"))


@llm.query("p7_counts", _USES + "SELECT g AS project_id, a AS code_a_id, b AS code_b_id, n_ab, n_a, n_b, n FROM pair")
def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of every pair of codes of a project used in one document."""
    p = _code_pairs(spark, sf_dir)
    return p.select(F.col("g").alias("project_id"), F.col("a").alias("code_a_id"), F.col("b").alias("code_b_id"), "n_ab", "n_a", "n_b", "n")


@llm.query("p7_surprise")
def p7_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with expected count, tail and q-value under the configuration null."""
    return _code_pairs(spark, sf_dir).withColumnsRenamed({"g": "project_id", "a": "code_a_id", "b": "code_b_id"})
