"""Problems 4, 5, 6 and 10: sentences, languages, scanned pages, abusive content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import abuse, language, ocr
from corpusloom.llm.queries import llm
from corpusloom.llm.sentences import fit_on, sentence_units
from corpusloom.session import table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qda_document").where("ocr_engine is null").select("id", "body")


@llm.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    return sentence_units(typed, fit_on(typed, "id", "body"))


@llm.query("p4_units")
def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document, scanned ones included, with their text."""
    docs = table(spark, sf_dir, "qda_document").select("id", "body")
    return sentence_units(docs, fit_on(docs, "id", "body"), with_text=True)


_LETTERS = r"[^\p{L}\p{N}]"
_ALL_LETTERS = "SELECT id, CAST(length(regexp_replace(body, '[^\\p{L}\\p{N}]', '', 'g')) AS BIGINT) AS letters FROM qda_document WHERE regexp_matches(body, '[\\p{L}\\p{N}]')"


def _letters(text: str) -> Column:
    return F.sum(F.length(F.regexp_replace(text, _LETTERS, ""))).cast("long").alias("letters")


@llm.query("p4_cover", _ALL_LETTERS)
def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of each document that lie in its sentence units: all of them, each once."""
    return p4_units(spark, sf_dir).groupBy("id").agg(_letters("text")).where("letters > 0")


@llm.query("p5_cover", _ALL_LETTERS)
def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of each document that lie in its stretches: all of them, each once."""
    body = table(spark, sf_dir, "qda_document").select(F.col("id").alias("_id"), "body")
    s = _stretches(spark, sf_dir).join(body, F.col("id") == F.col("_id"))
    return s.withColumn("text", F.expr("substring(body, char_start + 1, char_end - char_start)")).groupBy("id").agg(_letters("text")).where("letters > 0")


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "qda_document").select("id", "body", "language")
    return language.language_stretches(docs, language.fit_on(docs))


@llm.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stretches(spark, sf_dir).where("not label_ok or n_stretches > 1")
    return found.select("id", "char_start", "char_end", "lang")


@llm.query("p5_languages")
def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with language and confidence."""
    return _stretches(spark, sf_dir)


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "ocr_word"), table(spark, sf_dir, "ocr_page"), _typed(spark, sf_dir)


@llm.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.page_repairs(*_scans(spark, sf_dir))


@llm.query("p6_pages")
def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every page."""
    return ocr.page_texts(*_scans(spark, sf_dir))


def _abuse(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return abuse.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"), keep)


@llm.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).where("flagged").select("doc_id")


@llm.query("p10_scores")
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return _abuse(spark, sf_dir)


@llm.query("p10_sources")
def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their rate per source."""
    n = _abuse(spark, sf_dir, ("source",)).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.avg("score").alias("mean_score"))
    return n.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
