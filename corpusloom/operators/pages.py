"""Recognised pages: lines from words, confidence, documents from pages, hit tests, layout proposals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

REVIEW_BELOW = 0.6


def distinct_words(words: DataFrame) -> DataFrame:
    """Words delivered several times count once."""
    return words.dropDuplicates(["page_id", "word_index"])


def lines_from_words(words: DataFrame, joiner: str = " ") -> DataFrame:
    """Lines of each page: page_id, line_index, text, x, y, w, h, confidence (mean of known ones, null without)."""
    conf = F.avg(F.when(F.col("confidence") >= 0, F.col("confidence")))
    g = distinct_words(words).groupBy("page_id", "line_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_index", "text"))), lambda s: s["text"]), joiner).alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), conf.alias("confidence"),
    )
    return g.select("page_id", "line_index", "text", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "confidence")


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of each page's words with one, and whether the page needs review."""
    g = distinct_words(words).groupBy("page_id").agg(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("mean_confidence"), F.count("*").alias("n_words"))
    return g.withColumn("needs_review", F.coalesce(F.col("mean_confidence") < REVIEW_BELOW, F.lit(False)))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """Body and mean confidence of each document from its pages in order, blank lines between."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "page_id", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n\n")
    return pages.groupBy("document_id").agg(F.trim(text).alias("body"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_pages"))


def hit_test(boxes: DataFrame, points: DataFrame, key: str = "page_id") -> DataFrame:
    """For each point (point_id, key, px, py) the smallest box of its page that holds it; ties go to the first."""
    p = points.select("point_id", F.col(key).alias("_k"), "px", "py")
    inside = (F.col("px") >= F.col("x")) & (F.col("px") <= F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") <= F.col("y") + F.col("h"))
    hit = boxes.join(p, F.col(key) == F.col("_k")).where(inside)
    return hit.groupBy("point_id").agg(F.min(F.struct((F.col("w") * F.col("h")).alias("area"), "line_index")).alias("b")).select("point_id", F.col("b.line_index").alias("line_index"))


def best_trial(trials: DataFrame) -> DataFrame:
    """Per page the recognition trial with the best confidence weighted by the share of text it read."""
    score = F.col("confidence") * F.col("share")
    w = Window.partitionBy("page_id").orderBy(score.desc(), F.col("setting").asc())
    return trials.withColumn("score", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def propose_settings(trials: DataFrame, min_cjk: int = 2, cjk_conf: float = 0.4, cjk_ratio: float = 0.5) -> DataFrame:
    """Per page the language, direction and confidence to recognise it with, from trials of each setting.

    ``trials``: page_id, language, vertical, confidence (null counts as 0), text. Confidences of different scripts
    cannot be compared: a page is Japanese if its best Japanese trial (by confidence times Han and kana read) is
    sure enough and has enough of these, else it takes the best of the other trials (by confidence times characters
    read), written across. Pages without such a trial are 'und'. Equal trials go by language, then across before down.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")
    conf, chars = F.coalesce("confidence", F.lit(0.0)), F.length(plain)
    cjk = F.regexp_count(plain, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"))
    t = trials.select("page_id", "language", F.coalesce("vertical", F.lit(False)).alias("vertical"), conf.alias("confidence"), chars.alias("chars"), cjk.alias("cjk"))
    best = lambda by: F.max_by(F.struct("language", "vertical", "confidence", "chars", "cjk"), by)
    east = t.where("language = 'ja'").groupBy("page_id").agg(best(F.struct(F.col("confidence") * F.col("cjk"), ~F.col("vertical"))).alias("e"))
    rank = F.struct(F.col("confidence") * F.col("chars"), F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))
    west = t.where("language <> 'ja'").groupBy(F.col("page_id").alias("_p")).agg(best(rank).alias("w"))
    all_ = t.select(F.col("page_id").alias("_q")).distinct().join(east, F.col("_q") == F.col("page_id"), "left").join(west, F.col("_q") == F.col("_p"), "left")
    sure = F.coalesce((F.col("e.cjk") >= min_cjk) & (F.col("e.confidence") >= cjk_conf) & (F.col("e.cjk") / F.greatest("e.chars", F.lit(1)) >= cjk_ratio), F.lit(False))
    language = F.when(sure, "ja").otherwise(F.coalesce("w.language", F.lit("und")))
    vertical = F.when(sure, F.col("e.vertical")).otherwise(F.lit(False))
    out = all_.select(F.col("_q").alias("page_id"), language.alias("language"), vertical.alias("vertical"), F.when(sure, F.col("e.confidence")).otherwise(F.coalesce("w.confidence", F.lit(0.0))).alias("confidence"))
    return out.withColumn("label", T.layout_label(F.col("language"), F.col("vertical")))


def recognise(pages: DataFrame, engine: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of binary page images (path, page_index, content) read by ``engine``, with its failure, if any, as a column.

    ``engine`` gives for an image a list of {text, x, y, w, h, confidence, line_index}.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, index, content in zip(pdf.path, pdf.page_index, pdf.content):
                try:
                    found = engine(content)
                except Exception as e:  # noqa: BLE001 - a bad page must not end the job
                    rows.append((path, index, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, index, k, w.get("line_index", 0), w["text"], w["x"], w["y"], w["w"], w["h"], w.get("confidence", -1.0), None) for k, w in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "page_index", "word_index", "line_index", "text", "x", "y", "w", "h", "confidence", "error"])

    return pages.select("path", "page_index", "content").mapInPandas(run, "path string, page_index int, word_index int, line_index int, text string, x int, y int, w int, h int, confidence double, error string")
