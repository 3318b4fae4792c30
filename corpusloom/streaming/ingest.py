"""Watching a directory of notes: new files become documents as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.markdown import front_matter


def watch_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A stream of file_path, title, language, body of .md files below a path."""
    src = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    meta, body = front_matter(F.col("value"))
    d = src.withColumn("file_path", F.input_file_name()).withColumn("_m", meta).withColumn("body", body)
    return d.select("file_path", F.coalesce(F.col("_m")["title"], F.regexp_extract("file_path", r"([^/]+?)\.md$", 1)).alias("title"), F.col("_m")["language"].alias("language"), "body")


def append_documents(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each new file once to a parquet table."""
    out = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def audit_counts(audit: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Log entries per action and window of event time; entries later than ``late`` no longer count."""
    return audit.withWatermark("created_at", late).groupBy(F.window("created_at", window), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "action", "n")
