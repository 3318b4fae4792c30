"""Recall and precision on corpora whose truth is known, and edge cases of whole runs."""

import random

import pytest

from corpusloom.llm import abuse, language, sentences

WEST = ["The river rose to the mill.", "Mr. Hale paid 3.50 pounds to Dr. Lund, ca. 9 days later.", "“It is over.”", "Who broke the seal?", "They carried corn, oil, etc. to the barn.", "The deed (see p. 4. It is short.) was lost.", "He wrote to J. R. Moss in May."]
EAST = ["春が来た。", "「急げ！」と叫んだ。", "村は静かだった。", "誰が封を破ったのか？", "川は深い！"]
GERMAN = ["Der Bote kam am 3. Mai an.", "Der Müller verkaufte sein Korn an die Stadt.", "Wer hat das Siegel erbrochen?", "Die Brücke war noch nicht fertig."]


def texts(n, seed):
    """(text, units with offsets) of paragraphs in one of three languages."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pool, gap = rng.choice([(WEST, " "), (GERMAN, " "), (EAST, "")])
        t, units = "", []
        for p in range(rng.randint(1, 3)):
            t += "\n\n" if p else ""
            for k in range(rng.randint(2, 5)):
                t += gap if k else ""
                s = rng.choice(pool)
                units.append((len(t), len(t) + len(s)))
                t += s
        out.append((t, units))
    return out


def test_sentence_units_found():
    model = sentences.fit_sentences([t for t, _ in texts(400, 1)])
    found = right = true = 0
    for t, units in texts(200, 2):
        got = set(model.spans(t))
        found, right, true = found + len(got), right + len(got & set(units)), true + len(units)
    assert right >= 0.95 * true and right >= 0.95 * found


def test_languages_found():
    rng = random.Random(3)
    pools = {"en": WEST, "de": GERMAN, "ja": EAST}
    name = lambda t: next(k for k, v in pools.items() if any(s in t for s in v))
    rows = [(t, name(t) if rng.random() < 0.8 else rng.choice(["en", "de", "ja"])) for t, _ in texts(400, 4)]
    model = language.fit_language(rows)
    found = right = 0
    for k in range(150):
        (a, _), (b, _) = texts(2, 100 + k)
        want = [name(a), name(b)] if name(a) != name(b) else [name(a)]
        got = [g for _, _, g, _ in model.stretches(a + "\n\n" + b)]
        found, right = found + 1, right + (got == want)
    assert right >= 0.9 * found


def test_judging_whole_tables(spark):
    schema = "doc_id long, text string, lang string, source string, score int"
    rows = [(1, "Go and hang yourself, you worthless scum.", "en", "a", 1), (2, "The river rose.", None, None, 2), (3, None, "de", "a", 3), (4, "", "", "b", 4), (4, "", "", "b", 4), (None, "x", "en", "a", 5), (5, "long " * 30_000, "en", "b", 6)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, "abusive"), (1, 1, "abusive"), (2, 1, None), (99, 1, "clean"), (None, 1, "clean"), (3, 1, "clean"), (3, 2, "hateful")], "doc_id long, coder_id long, label string")
    for given in (labels, labels.where("false")):
        got = abuse.judge_documents(docs, given, keep=("source",)).collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4, 5] and all(0 <= r.score <= 1 for r in got)
        assert all(r.score == 0 and not r.flagged for r in got if r.doc_id in (3, 4))
        one = next(r for r in got if r.doc_id == 1)
        assert one.source == "a" and one.score == max(r.score for r in got)
    assert abuse.judge_documents(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("text", ["", " \n ", "。", "....", "\u0000", "“" * 500, "a" * 50_000, "。" * 20_000, "(" * 3000 + ")" * 3000])
def test_odd_texts(text):
    model = sentences.fit_sentences([])
    spans = model.spans(text)
    assert all(a < z and text[a:z].strip() == text[a:z] for a, z in spans)
    assert sum(z - a for a, z in spans) <= len(text)
