"""Polarity lexicons in their usual file forms, as (word, polarity) tables."""

import io
import tarfile
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

FORMATS = ("colon", "tab_polarity", "verb_phrases", "nouns")
#: Encodings tried in turn.
ENCODINGS = ("utf-8", "euc-jp", "cp932", "shift_jis")


def decode_any(content: Column, encoding: str | None = None) -> Column:
    """Binary content as text in the first encoding that fits, a given one before all others; null if none does."""
    order = ((encoding,) if encoding else ()) + ENCODINGS
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for e in order if b is not None else ():
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    continue
            return None

        return s.map(one)

    return decode(content)


def lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Numbered lines (line_no, line) of a lexicon file in any of the encodings, blank ones and comments left out."""
    text = spark.read.format("binaryFile").load(path).select(F.explode(F.expr("array(content)")).alias("c")).select(decode_any(F.col("c"), encoding).alias("t"))
    return numbered(text, "t")


def numbered(df: DataFrame, col: str) -> DataFrame:
    out = df.select(F.posexplode(F.split(F.col(col), r"\r?\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    return out.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse(rows: DataFrame, form: str) -> DataFrame:
    """(word, polarity) of numbered lines; an unknown form is an error.

    colon: word:reading:pos:score or word TAB score, bad scores skipped; tab_polarity: word TAB posi|nega;
    verb_phrases: label TAB phrase, a later neutral phrase never replaces a polar one; nouns: word TAB p|n|e.
    Of a word given several times the last line holds.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown form: {form}")
    tab = F.split("line", "\t")
    if form == "colon":
        parts = F.split("line", r"\t|:")
        word, pol = F.get(parts, F.lit(0)), F.element_at(parts, -1).try_cast("double")
        rows = rows.where(F.size(parts) > 1)
    elif form == "tab_polarity":
        kind = F.lower(F.get(tab, F.lit(1)))
        word, pol = F.get(tab, F.lit(0)), F.when(kind.contains("posi"), 1.0).when(kind.contains("nega"), -1.0)
    elif form == "verb_phrases":
        kind = F.get(tab, F.lit(0))
        word, pol = F.regexp_replace(F.get(tab, F.lit(1)), "[ 　]", ""), F.when(kind.startswith("ポジ"), 1.0).when(kind.startswith("ネガ"), -1.0).otherwise(0.0)
    else:
        kind = T.strip(F.get(tab, F.lit(1)))
        word, pol = F.get(tab, F.lit(0)), F.when(kind == "p", 1.0).when(kind == "n", -1.0).when(kind == "e", 0.0)
    found = rows.select("line_no", T.strip(word).alias("word"), pol.alias("polarity")).where("word <> '' and polarity is not null")
    rank = F.struct((F.col("polarity") != 0).cast("int").alias("p"), "line_no") if form == "verb_phrases" else F.struct("line_no")
    return found.groupBy("word").agg(F.max_by("polarity", rank).alias("polarity"))


def install(lexicon: DataFrame, path: str) -> None:
    """Write a lexicon; an empty one is an error."""
    if not lexicon.limit(1).count():
        raise ValueError("the lexicon is empty")
    lexicon.write.mode("overwrite").option("sep", "\t").csv(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, polarity double").option("sep", "\t").csv(path)


@dataclass(frozen=True)
class Known:
    """A public lexicon: how its file is written and which member of an archive it is."""

    language: str
    encoding: str
    form: str
    member: str = ""


# Keys, languages, encodings and member hints of the lexicons that can be installed. Their licences forbid
# shipping them; files are given by the user.
REGISTRY = {
    "takamura_pn": Known("ja", "euc-jp", "colon"),
    "tohoku_wago": Known("ja", "utf-8", "verb_phrases", "wago"),
    "tohoku_noun": Known("ja", "utf-8", "nouns", "pn.csv"),
}


def unpacked(content: bytes, hint: str = "") -> bytes:
    """The member of a zip or tar archive whose name holds ``hint`` (else its first file); other content as it is."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            return z.read(_member(names, hint))
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            files = {m.name: m for m in t.getmembers() if m.isfile()}
            return t.extractfile(files[_member(list(files), hint)]).read()
    except tarfile.TarError:
        return content


def _member(names: list[str], hint: str) -> str:
    if not names:
        raise ValueError("the archive is empty")
    return next((n for n in names if hint and hint in n), names[0])


def install_known(spark: SparkSession, key: str, source: str, folder: str) -> DataFrame:
    """Read a registered lexicon from a file or archive, write it to ``folder``/key and return it; unknown keys are errors."""
    if key not in REGISTRY:
        raise KeyError(f"unknown lexicon: {key} (known: {', '.join(REGISTRY)})")
    known = REGISTRY[key]

    @F.pandas_udf("binary")
    def member(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else unpacked(bytes(b), known.member))

    text = spark.read.format("binaryFile").load(source).select(decode_any(member(F.col("content")), known.encoding).alias("t"))
    install(parse(numbered(text, "t"), known.form), f"{folder}/{key}")
    return load(spark, f"{folder}/{key}")


def installed(spark: SparkSession, folder: str) -> list[str]:
    """Keys of the registered lexicons that ``folder`` holds."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for key in REGISTRY:
        path = hadoop.Path(f"{folder}/{key}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(key)
    return out


def load_combined(spark: SparkSession, base: DataFrame, folder: str, language: str = "ja") -> DataFrame:
    """``base`` (word, polarity) with all installed lexicons of a language on top, in the registry's order."""
    out = base.select("word", "polarity")
    for key in installed(spark, folder):
        if REGISTRY[key].language == language:
            over = load(spark, f"{folder}/{key}")
            out = out.join(over.select(F.col("word").alias("_o")), F.col("word") == F.col("_o"), "left_anti").unionByName(over)
    return out
