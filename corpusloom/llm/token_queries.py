"""Problems 8 and 9: token ids of the corpus, packing into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import count_column, decode_column, encode_column
from corpusloom.llm.packing import pack
from corpusloom.llm.queries import llm
from corpusloom.session import ample, table


#: What opens a document, up to its first stop or line break, is its prompt and bears no loss.
PROMPT = r"^[^\n.!?。！？।]*[\n.!?。！？।]+"


@llm.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(ample(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "ids")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ample(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    head = F.length(F.regexp_extract("text", PROMPT, 0))
    sized = count_column(docs.withColumn("head", head), head="head").select("doc_id", "n_tokens", "n_head")
    return pack(sized, prompt_col="n_head")


@llm.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a second piece lies in a container."""
    return _packed(spark, sf_dir).where("piece > 0").select("doc_id").distinct()


@llm.query("p9_containers")
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container."""
    return _packed(spark, sf_dir)


@llm.query("p9_fill")
def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by number of segments: how many, their tokens, loss-bearing tokens and the unused space."""
    size = F.col("tok_end") - F.col("tok_start")
    c = _packed(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("n_segments"), F.sum(size).alias("tokens"), F.sum("n_loss").alias("loss"))
    return c.groupBy("n_segments").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.sum(2048 - F.col("tokens")).alias("unused"))


# what SQL can say of them


@llm.query("p8_roundtrip", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document read back as text."""
    return decode_column(p8_ids(spark, sf_dir)).select("doc_id", F.md5("decoded").alias("text_md5"))


@llm.query("p9_cover", "SELECT doc_id, CAST(0 AS BIGINT) AS first_token, true AS whole, true AS within FROM documents")
def p9_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of every document are all of it, and whether their containers hold to the three limits."""
    p = _packed(spark, sf_dir)
    size = F.col("tok_end") - F.col("tok_start")
    ok = (F.sum(size) <= 2048) & (F.count("*") <= 128) & ((F.sum("n_loss") <= 1792) | (F.sum((F.col("n_loss") > 0).cast("int")) == 1))
    full = p.groupBy(F.col("container_id").alias("_c")).agg(ok.alias("ok"))
    return p.join(full, F.col("container_id") == F.col("_c")).groupBy("doc_id").agg(
        F.min("tok_start").alias("first_token"), (F.sum(size) == F.max("tok_end")).alias("whole"), F.min("ok").alias("within")
    )
