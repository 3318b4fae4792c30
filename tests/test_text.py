import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, f, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("v")).alias("r")).first().r


def spans(x):
    return [(s.char_start, s.char_end) for s in x]


def test_sentences(spark):
    assert len(one(spark, "一つ目。二つ目。\n三つ目", T.sentence_spans)) == 3
    assert spans(one(spark, "a. b! 　 ?", T.sentence_spans)) == [(0, 5), (5, 9)]
    assert one(spark, None, T.sentence_spans) == [] and one(spark, "", T.sentence_spans) == []


def test_paragraphs(spark):
    t = "one\ntwo\n \n\nthree\n\n"
    assert [t[a:b] for a, b in spans(one(spark, t, T.paragraph_spans))] == ["one\ntwo", "three"]
    assert one(spark, " \n\n ", T.paragraph_spans) == []
    assert one(spark, t, lambda c: T.paragraph_index(T.paragraph_starts(c), F.lit(12))) == 1


def test_chars_and_atoms(spark):
    assert spans(one(spark, "a𠮷", T.char_spans)) == [(0, 1), (1, 2)]
    assert one(spark, "", T.char_spans) == []
    assert spans(one(spark, [2, 9, -1, 2], lambda c: T.atomic_spans(c, F.lit(5)), "v array<int>")) == [(0, 2), (2, 5)]


@pytest.mark.parametrize(("text", "lang"), [("漢字かな", "ja"), ("plain text", "en"), ("漢 a", "ja"), ("123", "und"), (None, "und")])
def test_language(spark, text, lang):
    assert one(spark, text, T.detect_language) == lang


def test_links_years_grams(spark):
    assert one(spark, "[[b]] [[a|x]] [[b#h]] [[ ]]", T.wikilinks) == ["b", "a"]
    assert one(spark, "ca. 1867-68", T.year_of) == 1867 and one(spark, "none", T.year_of) is None
    assert one(spark, "a b　c", T.ngrams) == ["ab", "bc"] and one(spark, "a", T.ngrams) == ["a"] and one(spark, None, T.ngrams) == []


def test_normalise(spark):
    assert one(spark, "舊學ゝ", T.normalize_old) == "旧学"
    assert one(spark, "甲x", lambda c: T.normalize_old(c, {"甲": "きのえ"})) == "きのえx"


def test_citations(spark):
    df = spark.createDataFrame([("A", "T", 1867, "S"), (None, "T", None, None)], "a string, t string, y int, s string")
    f = lambda style, **k: [r.r for r in df.select(T.citation(F.col("a"), F.col("t"), F.col("y"), F.col("s"), style, **k).alias("r")).collect()]
    assert f("apa")[0] == "A (1867). T. S." and f("sist02") == ["A. T. S, 1867.", ". T. n.d.."]
    assert f("chicago", locator=F.lit("p. 2"))[0] == 'A. "T." S, 1867, p. 2.'
    assert f("sist02", quote=F.lit("q"))[0] == "「q」（A. T. S, 1867.）"
    with pytest.raises(ValueError):
        f("mla")


def test_colors_and_names(spark):
    assert one(spark, "#ffffff", T.text_color) == "#000000" and one(spark, "#000080", T.text_color) == "#ffffff" and one(spark, "red", T.text_color) == "#000000"
    assert one(spark, 5, lambda c: T.color_scale(c, F.lit(10)), "v int") == "#ff7f6e"
    assert one(spark, 'a/b:"c', T.safe_name) == "a_b_c" and one(spark, " ", T.safe_name) == "untitled"
    assert one(spark, "<a&'>", T.html_escape) == "&lt;a&amp;&#x27;&gt;"


def test_like(spark):
    assert one(spark, "Été OF", lambda c: T.like_ascii(c, "of")) and not one(spark, "Été", lambda c: T.like_ascii(c, "ét"))
    assert one(spark, "a\\b", lambda c: T.like_ascii(c, "\\"))


def test_spans_of_long_texts(spark):
    from corpusloom.functions import text as T

    t = "".join(f"{'x' * (i % 7 + 1)}。" for i in range(5000)) + "\n\nend" + "\n\n\n  \n\nlast"
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string")
    rows = df.select(T.sentence_spans(df.t).alias("s"), T.paragraph_spans(df.t).alias("p"), T.paragraph_starts(df.t).alias("b")).collect()
    s = [(x.char_start, x.char_end) for x in rows[0].s]
    assert len(s) == 5002 and all(t[a:z].strip() for a, z in s) and all(x[1] <= y[0] for x, y in zip(s, s[1:]))
    assert [t[x.char_start : x.char_end] for x in rows[0].p][1:] == ["end", "last"] and len(rows[0].b) == 2
    assert [list(r) for r in rows[1:]] == [[[], [], []]] * 2
