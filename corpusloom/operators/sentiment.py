"""Lexicon sentiment with negation, over sentences, paragraphs, segments or documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

UNITS = ("sentence", "paragraph", "segment", "document")
#: Tokens before a word, or characters behind it, in which a negation turns it.
TOKEN_WINDOW, CHAR_WINDOW = 3, 4

# The seed words of both languages with their polarities, and the negations; a real analysis loads a
# lexicon on top (sources.lexicons).
SEED_JA = {
    "喜び": 0.8, "嬉しい": 0.8, "良い": 0.6, "善": 0.6, "忠": 0.5, "忠義": 0.7, "名誉": 0.6, "勝利": 0.7, "平和": 0.6, "安寧": 0.6, "功": 0.4, "賢": 0.5, "仁": 0.5, "栄光": 0.7, "繁栄": 0.6,
    "悲しい": -0.8, "苦しい": -0.7, "悪い": -0.6, "不忠": -0.8, "逆賊": -0.9, "敗北": -0.7, "戦乱": -0.6, "罪": -0.6, "恥": -0.6, "怒り": -0.6, "憎い": -0.7, "滅亡": -0.7, "死": -0.4, "災い": -0.6, "混乱": -0.5,
}
NEGATIONS_JA = frozenset({"ない", "ず", "ぬ", "なし", "ありません", "無", "不", "非", "ざる"})
SEED_EN = {
    "good": 0.7, "great": 0.8, "happy": 0.8, "victory": 0.7, "peace": 0.6, "honor": 0.6, "glory": 0.7, "prosperity": 0.6, "loyal": 0.6, "wise": 0.5,
    "bad": -0.7, "sad": -0.8, "evil": -0.9, "defeat": -0.7, "war": -0.4, "death": -0.5, "traitor": -0.9, "crime": -0.6, "shame": -0.6, "chaos": -0.5,
}
NEGATIONS_EN = frozenset({"not", "no", "never", "none", "without", "n't", "cannot"})


@dataclass(frozen=True)
class Lexicon:
    """Words with polarities, negations and the language that decides how texts are read."""

    name: str
    language: str
    words: Mapping[str, float] = field(default_factory=dict)
    negations: frozenset[str] = frozenset()

    def merge(self, other: Lexicon) -> Lexicon:
        """Both together; the other's polarity holds where both have a word."""
        return Lexicon(f"{self.name}+{other.name}", other.language, {**self.words, **other.words}, self.negations | other.negations)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.words.items()), "word string, polarity double")


def merge_frames(under: DataFrame, over: DataFrame) -> DataFrame:
    """Lexicon tables (word, polarity) put on one another: the second's polarity holds where both have a word."""
    rest = under.join(over.select(F.col("word").alias("_o")), F.col("word") == F.col("_o"), "left_anti")
    return rest.select("word", "polarity").unionByName(over.select("word", "polarity"))


def builtin(language: str) -> Lexicon:
    """The seed lexicon of a language; empty for one without."""
    if language == "ja":
        return Lexicon("builtin-ja", "ja", SEED_JA, NEGATIONS_JA)
    if language == "en":
        return Lexicon("builtin-en", "en", SEED_EN, NEGATIONS_EN)
    return Lexicon("empty", language)


def word_hits(text: Column, negations: Sequence[str]) -> Column:
    """Array of (word, negated) of the lower-case words of a text; a negation among the three before negates."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z']+"), F.lit(0)), lambda w: F.lower(w))
    return T.let(words, lambda w: _negated(w, negations, ahead=False))


def _negated(words: Column, negations: Sequence[str], ahead: bool) -> Column:
    """Array of (word, negated): whether a negation is among the ``TOKEN_WINDOW`` words behind (``ahead``) or before."""
    neg = F.array(*map(F.lit, sorted(negations))) if negations else F.expr("cast(array() as array<string>)")

    def near(i: Column) -> Column:
        return F.slice(words, i + 2, F.lit(TOKEN_WINDOW)) if ahead else F.slice(words, F.greatest(i - (TOKEN_WINDOW - 1), F.lit(1)), F.least(i, F.lit(TOKEN_WINDOW)))

    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.exists(near(i), lambda p: F.array_contains(neg, p) | p.endswith("n't")).alias("negated")))


def scan_hits(text: Column, words: Mapping[str, float], negations: Sequence[str]) -> Column:
    """Array of (word, negated): leftmost longest dictionary words that do not overlap; a negation in the next four characters negates."""
    if not words:
        return F.expr("cast(array() as array<struct<word:string,negated:boolean>>)")
    alt = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    pattern = rf"({alt})(?=([\s\S]{{0,{CHAR_WINDOW}}}))"
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    behind = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    return F.zip_with(found, behind, lambda w, b: F.struct(w.alias("word"), T.any_contains(b, sorted(negations)).alias("negated")))


def token_hits(tokens: Column, negations: Sequence[str], ahead: bool) -> Column:
    """Array of (word, negated) of tokens (surface, start); ``ahead``: negations follow a word, else they go before it."""
    return T.let(F.transform(tokens, lambda t: t["surface"]), lambda w: _negated(w, negations, ahead))


def tokenize(df: DataFrame, text: str, tokenizer: Callable[[str], list[tuple[str, int]]]) -> DataFrame:
    """``df`` with ``tokens``, an array of (surface, start), by a callable (a morphological analyser, say).

    Old characters are normalised before. Null texts have no tokens. The callable runs in batches on the workers.
    """
    cols = [c for c in df.columns if c != "tokens"]
    src = df.select(*cols, T.normalize_old(F.coalesce(F.col(text), F.lit(""))).alias("_plain"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"surface": w, "start": int(at)} for w, at in tokenizer(t)] if t else [] for t in pdf._plain]
            yield pdf[cols].assign(tokens=found)

    none = F.expr("cast(array() as array<struct<surface:string,start:int>>)").alias("tokens")
    return src.mapInPandas(run, df.select(*cols, none).schema)


def _hits(text: Column, lexicon: Lexicon) -> Column:
    return word_hits(text, lexicon.negations) if lexicon.language == "en" else scan_hits(text, lexicon.words, lexicon.negations)


def _valued(hits: Column, lexicon: Lexicon) -> Column:
    """Polarities of the hits that are in the lexicon."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.words.items() for x in kv]) if lexicon.words else F.expr("cast(map() as map<string,double>)")
    return F.filter(F.transform(hits, lambda h: F.when(h["negated"], -F.element_at(table, h["word"])).otherwise(F.element_at(table, h["word"]))), lambda p: p.isNotNull())


def _with_scores(df: DataFrame, polarities: Column) -> DataFrame:
    out = df.withColumn("_hits", polarities)
    n = F.size("_hits")
    total = F.aggregate("_hits", F.lit(0.0), lambda s, x: s + x)
    return out.withColumns({
        "polarity": F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / n))),
        "n_positive": F.size(F.filter("_hits", lambda x: x > 0)), "n_negative": F.size(F.filter("_hits", lambda x: x < 0)), "n_words": n,
    }).drop("_hits")


def score(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """``df`` with polarity, n_positive, n_negative and n_words.

    Old characters are normalised first. The polarity is the mean over the words found, words of polarity 0
    included, within -1 and 1; 0 without any. Null and empty texts have none. The words stand in the plan: for a
    lexicon of thousands there is :func:`score_large`.
    """
    return _with_scores(df, _valued(_hits(T.normalize_old(F.col(text)), lexicon), lexicon))


def score_tokens(df: DataFrame, text: str, lexicon: Lexicon, tokenizer: Callable[[str], list[tuple[str, int]]]) -> DataFrame:
    """As :func:`score`, over the tokens of a callable; negations precede English words and follow all others."""
    out = tokenize(df, text, tokenizer)
    return _with_scores(out, _valued(token_hits(F.col("tokens"), lexicon.negations, lexicon.language != "en"), lexicon)).drop("tokens")


def score_by_language(df: DataFrame, text: str, language: str, lexicons: Sequence[Lexicon]) -> DataFrame:
    """As :func:`score`, each row by the lexicon of its language ('en', 'ja', ...); a language without one scores 0."""
    plain, pick = T.normalize_old(F.col(text)), None
    for lex in lexicons:
        own = _valued(_hits(plain, lex), lex)
        pick = F.when(F.col(language) == lex.language, own) if pick is None else pick.when(F.col(language) == lex.language, own)
    none = F.expr("cast(array() as array<double>)")
    return _with_scores(df, none if pick is None else pick.otherwise(none))


def score_large(df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: Sequence[str], language: str = "en") -> DataFrame:
    """(key, polarity, n_positive, n_negative, n_words) against a lexicon table (word, polarity) of any size.

    What a text may have of the lexicon (English: its words; otherwise the substrings that are as long as some
    entry, in chunks) is exploded and joined with it: with a broadcast of it up to ``BROADCAST_ENTRIES`` entries, sorted
    and merged beyond. Texts without a word of the lexicon have polarity 0. ``key`` must be unique; of an entry given
    twice the smaller polarity holds.
    """
    lex = lexicon.where("word is not null and word <> '' and polarity is not null").groupBy(F.col("word").alias("_w")).agg(F.min("polarity").alias("_p"))
    how, sizes = _beside_texts(lex)
    plain = df.select(key, T.normalize_old(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    if language == "en":
        hits = plain.select(key, F.explode(word_hits(F.col("_t"), negations)).alias("h")).select(key, "h.word", "h.negated")
        valued = hits.join(lex.hint(how), F.col("word") == F.col("_w")).select(key, F.when(F.col("negated"), -F.col("_p")).otherwise(F.col("_p")).alias("p"))
        s = valued.groupBy(key).agg(F.sum("p").alias("sum"), F.count_if(F.col("p") > 0).alias("pos"), F.count_if(F.col("p") < 0).alias("neg"), F.count("*").alias("n"))
    else:
        s = _scan_large(plain, key, lex, how, sizes, negations)
    s = s.withColumnRenamed(key, "_key")
    mean = F.coalesce(F.col("sum") / F.col("n"), F.lit(0.0))
    return df.select(key).join(s, F.col(key) == F.col("_key"), "left").select(
        key, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("polarity"), *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("pos", "n_positive"), ("neg", "n_negative"), ("n", "n_words"))]
    )


#: A lexicon of at most so many entries, and bytes of their words, is broadcast.
BROADCAST_ENTRIES, BROADCAST_BYTES = 200_000, 16 << 20


def _beside_texts(lex: DataFrame) -> tuple[str, list[int]]:
    """How the lexicon (_w, _p) is joined with exploded texts, and the lengths of its words.

    Spark must not choose by its own estimate: it takes the texts' side for as large as their files, though it has
    hundreds of rows for each text, and broadcasts that.
    """
    found = lex.groupBy(F.length("_w").alias("n")).agg(F.count("*").alias("k"), F.sum(F.octet_length("_w")).alias("b")).orderBy("n").collect()  # lengths of words: few
    small = sum(r["k"] for r in found) <= BROADCAST_ENTRIES and sum(r["b"] for r in found) <= BROADCAST_BYTES
    return "broadcast" if small else "merge", [r["n"] for r in found]


#: Characters of a text that one row of the scan holds.
SCAN_CHUNK = 256


def _scan_large(plain: DataFrame, key: str, lex: DataFrame, how: str, sizes: Sequence[int], negations: Sequence[str]) -> DataFrame:
    """Sums over the leftmost longest entries (of these lengths) that do not overlap, a negation in the next four characters negating."""
    behind = max(sizes, default=1) + CHAR_WINDOW
    cut = rf"([\s\S]{{1,{SCAN_CHUNK}}})(?=([\s\S]{{0,{behind}}}))"
    found = [F.regexp_extract_all("_t", F.lit(cut), F.lit(k)) for k in (1, 2)]
    chunks = plain.select(key, F.posexplode(F.zip_with(*found, lambda a, b: F.struct(F.length(a).alias("n"), F.concat(a, b).alias("t")))).alias("i", "c"))
    chunks = chunks.select(key, (F.col("i") * SCAN_CHUNK).alias("base"), F.col("c.n").alias("n"), F.col("c.t").alias("t"))
    # only where an entry may begin, with the lengths of those that begin so
    heads = F.broadcast(lex.groupBy(F.substring("_w", 1, 1).alias("_h")).agg(F.collect_set(F.length("_w")).alias("_n")))  # first characters: a script's
    opened = chunks.select(key, "base", "n", "t", F.posexplode(F.split("t", "")).alias("i", "h")).where("i < n").join(heads, F.col("h") == F.col("_h"))
    tries = opened.select(key, "base", "t", (F.col("i") + 1).alias("at"), F.explode("_n").alias("n")).select(
        key, (F.col("base") + F.col("at")).alias("at"), "n", F.substring("t", F.col("at"), F.col("n")).alias("w"), F.substring("t", F.col("at") + F.col("n"), F.lit(CHAR_WINDOW)).alias("b")
    )
    met = tries.where(F.length("w") == F.col("n")).join(lex.hint(how), F.col("w") == F.col("_w"))
    met = met.select(key, "at", "n", F.when(T.any_contains(F.col("b"), sorted(negations)), -F.col("_p")).otherwise(F.col("_p")).alias("p"))
    order = F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "p")))
    free = F.struct(F.lit(0).alias("next"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(0).cast("long").alias("n"))
    take = lambda acc, h: F.when(
        h["at"] >= acc["next"],
        F.struct((h["at"] - h["n"]).cast("int").alias("next"), (acc["sum"] + h["p"]).alias("sum"), (acc["pos"] + (h["p"] > 0).cast("long")).alias("pos"), (acc["neg"] + (h["p"] < 0).cast("long")).alias("neg"), (acc["n"] + 1).alias("n")),
    ).otherwise(acc)
    return met.groupBy(key).agg(order.alias("h")).select(key, F.aggregate("h", free, take).alias("a")).select(key, "a.sum", "a.pos", "a.neg", "a.n")


def units(documents: DataFrame, unit: str, segments: DataFrame | None = None) -> DataFrame:
    """document_id, segment_id, char_start, char_end, text of every unit. An unknown unit is an error."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    d = documents.select(F.col("id").alias("document_id"), F.coalesce("body", F.lit("")).alias("body"))
    none = F.lit(None).cast("long").alias("segment_id")
    if unit == "document":
        return d.select("document_id", none, F.lit(0).alias("char_start"), F.length("body").alias("char_end"), F.col("body").alias("text"))
    if unit == "segment":
        s = segments.select(F.col("id").alias("segment_id"), F.col("document_id").alias("_d"), "char_start", "char_end")
        out = s.join(d, F.col("_d") == F.col("document_id"))
    else:
        spans = T.sentence_spans(F.col("body")) if unit == "sentence" else T.paragraph_spans(F.col("body"))
        out = d.withColumn("u", F.explode(spans)).select("document_id", "body", none, F.col("u.char_start").alias("char_start"), F.col("u.char_end").alias("char_end"))
    return out.select("document_id", "segment_id", "char_start", "char_end", F.expr("substring(body, char_start + 1, char_end - char_start)").alias("text"))


def analyze(documents: DataFrame, unit: str, lexicon: Lexicon | Sequence[Lexicon] | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Scores of all units: document_id, segment_id, unit, char_start, char_end, polarity, n_words, dictionary.

    One lexicon reads every document. Several (without any: the built-in ones) read the documents of their language,
    by its label in any notation, or by the script where the label is missing; others score 0.
    """
    u = units(documents, unit, segments)
    if isinstance(lexicon, Lexicon):
        s = score(u, "text", lexicon).withColumn("dictionary", F.lit(lexicon.name))
    else:
        many = [builtin("en"), builtin("ja")] if lexicon is None else list(lexicon)
        lang = documents.select(F.col("id").alias("_l"), T.language_of(F.col("language"), F.col("body")).alias("_lang"))
        name = F.create_map(*[F.lit(x) for lex in many for x in (lex.language, lex.name)])
        s = score_by_language(u.join(lang, F.col("document_id") == F.col("_l")), "text", "_lang", many)
        s = s.withColumn("dictionary", F.coalesce(F.element_at(name, F.col("_lang")), F.lit("empty")))
    return s.select("document_id", "segment_id", F.lit(unit).alias("unit"), "char_start", "char_end", "polarity", "n_words", "dictionary")


def replace_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored scores after a new run: what it scored again, whatever the dictionary, is replaced by (document, unit)."""
    keys = new.select(F.col("document_id").alias("_d"), F.col("unit").alias("_u")).distinct()
    kept = old.join(keys, (F.col("document_id") == F.col("_d")) & (F.col("unit") == F.col("_u")), "left_anti")
    return kept.unionByName(new)


def polarity_by_year(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Mean polarity and number of units per year."""
    d = documents.where("year is not null").select(F.col("id").alias("_d"), "year")
    return scores.join(d, F.col("document_id") == F.col("_d")).groupBy("year").agg(F.avg("polarity").alias("mean_polarity"), F.count("*").alias("n_units"))


def polarity_by_code(scores: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment polarities per code: n, mean, min, max."""
    s = segments.select(F.col("id").alias("_s"), "code_id")
    return scores.join(s, F.col("segment_id") == F.col("_s")).groupBy("code_id").agg(F.count("*").alias("n"), F.avg("polarity").alias("mean_polarity"), F.min("polarity").alias("min_polarity"), F.max("polarity").alias("max_polarity"))
