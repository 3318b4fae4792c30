import random

import numpy as np
import pytest

from corpusloom.llm import abuse, convnet, language, maxent, ocr, sentences

STARTS = ["The river rose", "Our clerk wrote", "In spring the men left", "A letter came", "They sold the barn"]
ENDS = ["to the mill", "before winter", "without a word", "near the old road", "for two pounds"]


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    s = lambda: f"{rng.choice(STARTS)} {rng.choice(ENDS)}."
    t = lambda: rng.choice([s(), s(), s(), f"Mr. {rng.choice(['Hale', 'Moss'])} paid 3.50 to Dr. Lund, ca. 9 days later.", "“It is over.”", "The man asked: “Who goes there?”"])
    return ["\n\n".join(" ".join(t() for _ in range(4)) for _ in range(3)) for _ in range(n)]


def eastern(n=60, seed=1):
    rng = random.Random(seed)
    t = lambda: rng.choice(["春が来た。", "村は静かだった。", "「急げ！」と叫んだ。", "「なぜか？」と言った。", "川は深い！", "「もう遅い。」と答えた。"])
    return ["\n\n".join("".join(t() for _ in range(4)) for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return sentences.fit_sentences(corpus() + eastern())


def cut(model, text):
    return [text[a:b] for a, b in model.spans(text)]


def test_sentences(model):
    t = "Heading\n\nMr. Hale paid 3.50 to Dr. Lund, ca. 9 days later. The man asked: “Who goes there?” A letter\ncame before winter. “Stop! Go.” so he cried (see p. 4. It is short.) and left."
    assert cut(model, t) == ["Heading", "Mr. Hale paid 3.50 to Dr. Lund, ca. 9 days later.", "The man asked: “Who goes there?”", "A letter\ncame before winter.", "“Stop! Go.” so he cried (see p. 4. It is short.) and left."]
    assert cut(model, "春になった。「誰か？」と尋ねた。道は遠い！") == ["春になった。", "「誰か？」と尋ねた。", "道は遠い！"]
    assert model.spans(None) == model.spans("") == model.spans(" \n　\n ") == []
    assert cut(model, "　 a b. \n") == ["a b."]
    long = "The river rose to the mill. " * 3000
    assert len(model.spans(long)) == 3000


def test_sentences_without_training():
    assert cut(sentences.fit_sentences([]), "He left at noon. Then rain fell.\n\nEnd") == ["He left at noon.", "Then rain fell.", "End"]


def test_sentence_units(spark, model):
    df = spark.createDataFrame([(1, "It rained. It ended.", 3), (2, None, 4), (None, "x", 5), (3, "", 6)], "id long, body string, char_start int")
    assert [(r.id, r.char_start, r.char_end) for r in sentences.sentence_units(df, model).orderBy("char_start").collect()] == [(1, 0, 10), (1, 11, 20)]
    assert sentences.sentence_units(df.where("false"), model).count() == 0


def test_maxent_learns():
    x = maxent.matrix([["a"], ["b"]] * 50)
    w = maxent.fit(x, np.array([1.0, 0.0] * 50), np.ones(100), maxent.prior({}))
    a, b = maxent.score(w, [["a"], ["b"]])
    assert a > 1 > -1 > b


def test_convnet_gradients():
    rng = np.random.default_rng(0)
    for shape in ((3, 12), (3, 12, 2)):
        net = convnet.ConvNet(20, 2, 4, (2, 3), 3)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        x = rng.integers(1, 20, shape)
        y = np.array([0, 1, 1])

        def loss(net=net, x=x, y=y):
            return -np.log(convnet.softmax(net.forward(net.embedded(x))[0] @ net.p["U"] + net.p["c"])[np.arange(3), y]).sum()

        emb = net.embedded(x)
        f, places = net.forward(emb)
        d = convnet.softmax(f @ net.p["U"] + net.p["c"])
        d[np.arange(3), y] -= 1
        g = net.gradients(x, emb, f, places, d)
        rows, sums = g["E"]
        for name, at, want in (("W2", (1, 1), g["W2"][1, 1]), ("U", (2, 0), g["U"][2, 0]), ("E", (rows[0], 1), sums[0, 1])):
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(want, abs=1e-5)
            net.p[name][at] = old


FOREIGN = {"de": "Der Fluss stieg bis zur Mühle, und die Leute gingen nach Hause.", "fr": "La rivière monta jusqu'au moulin et les gens rentrèrent chez eux.", "ru": "Река поднялась до мельницы, и люди ушли домой.", "ja": "川は水車まで上がり、人々は家に帰った。"}


@pytest.fixture(scope="module")
def lid():
    return language.fit_language([(t, "en") for t in corpus(40)] + [(v + " " + v, {"de": "German", "fr": "fre", "ru": "ru", "ja": "日本語"}[k]) for k, v in FOREIGN.items() for _ in range(12)] + [(FOREIGN["de"], "fr")])


def test_labels():
    assert [language.language_code(x) for x in ("en-GB", "JPN", "Deutsch", "und", "", None, "n/a")] == ["en", "ja", "de", None, None, None, None]


def test_language(lid, spark):
    for k, v in FOREIGN.items():
        (s,) = lid.stretches(v)
        assert s[2] == k and 0 < s[3] <= 1
    mixed = "The river rose to the mill. A letter came before winter.\n" + FOREIGN["ru"] + " " + FOREIGN["ru"]
    got = lid.stretches(mixed)
    assert [(mixed[a : a + 3], g) for a, _, g, _ in got] == [("The", "en"), ("Рек", "ru")] and got[1][1] == len(mixed)
    df = spark.createDataFrame([(1, mixed, "en"), (2, FOREIGN["de"], None), (3, None, "en"), (4, " ", "en")], "id long, body string, language string")
    rows = language.language_stretches(df, lid).collect()
    assert sorted((r.id, r.lang, r.label_ok, r.n_stretches) for r in rows) == [(1, "en", True, 2), (1, "ru", True, 2), (2, "de", False, 1)]
    assert language.language_stretches(df.where("false"), lid).count() == 0


# scanned pages


def lex():
    words = {w: (50, w) for w in "the harbour master counted remaining sheep in upper pasture and disappearance of casks from well-known printer a garrison".split()}
    tri = {}
    for t in ["土地の習わしに従い"] * 5:
        for i in range(len(t) - 2):
            tri[t[i : i + 3]] = tri.get(t[i : i + 3], 0) + 1
    return ocr.Lexicon(words | {"garrison": (50, "Garrison")}, tri)


@pytest.mark.parametrize(("read", "right"), [("thc", "the"), ("hatbout", "harbour"), ("tlieharbour", None), ("theharbour,", "the harbour"), ("Mastet", "Master"), ("pr!nter", "printer"), ("sheep.", None), ("XIV", None), ("1867", None), ("Quux", None), ("c0untecl", "counted")])
def test_readings(read, right):
    assert lex().repair(read, 0.4) == right


def test_joining_and_han():
    x = lex()
    assert x.joined("disappear", "ance") == "disappearance" and x.joined("well", "known") == "well-known" and x.unmarked("disap", "pearance") == "disappearance" and x.unmarked("the", "harbour") is None
    assert x.misread_cjk(list("士地の習わしに従い")) == {0: "土"} and x.misread_cjk(list("土地の習わしに従い")) == {}


PAGE = ["Annals of the town", "the harbour master counted the remaining sheep in the upper", "pasture and thc disappear-", "ance of casks ^ from the", "printer.", "12"]


def word_rows(pages):
    for p in pages:
        k = 0
        for li, line in enumerate(PAGE):
            for x, w in enumerate(line.split(" ")):
                yield (p, k, li, w, 70 + 60 * x, 90 + 31 * li, 50, 20, 0.5)
                k += 1


SCHEMA = "page_id long, word_index int, line_index int, text string, x int, y int, w int, h int, confidence double"


def test_page_repairs(spark):
    words = spark.createDataFrame([*word_rows(range(1, 9)), *word_rows([1]), (9, None, 0, "x", 0, 0, 1, 1, None), (9, 0, 0, None, 0, 0, 1, 1, None)], SCHEMA)
    pages = spark.createDataFrame([(p, 1, p - 1) for p in range(1, 8)], "page_id long, document_id long, page_index int")
    typed = spark.createDataFrame([(1, "The harbour master counted the remaining sheep in the upper pasture and the disappearance of casks from the printer. " * 3)], "id long, body string")
    got = ocr.page_repairs(words, pages, typed).where("page_id = 3").collect()
    assert {(r.word_index, r.kind, r.repaired) for r in got} == {(0, "header", ""), (16, "misread", "the"), (17, "hyphen", "disappearance"), (21, "speck", ""), (25, "page_number", "")}
    text = ocr.page_texts(words, pages, typed).where("page_id = 3").first().text
    assert text == "the harbour master counted the remaining sheep in the upper pasture and the disappearance of casks from the printer."
    assert ocr.page_repairs(words.where("false"), pages, typed).count() == 0


# abuse


@pytest.mark.parametrize(("text", "want"), [("sh​it", "shit"), ("ѕhіt", "shit"), ("a w h o r e here", "awhore whore here"), ("ПАРОХОД", "пароход"), ("U. S. law", "u. s. law")])
def test_plain(text, want):
    assert abuse.plain(text) == want


def test_tokens():
    assert abuse.token("1d10t")[0] == "idiot" and abuse.token("b*stard")[0] == "<mask>" and abuse.token("1867")[0] == "0"
    assert abuse.token("basatrd")[2] == abuse.token("bastard")[2] and abuse.slots("") == []


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(3)
    bad = ["You {} coward, I will break your bones.", "What a {} you are.", "Those {} must be wiped out, all of them."]
    ok = corpus(150)
    rows = [(t, "en", False) for t in ok[:80]] + [(t, "en", None) for t in ok[80:]]
    rows += [(t + " " + rng.choice(bad).format(rng.choice(["idiot", "bastard", "scum"])), "en", True) for t in corpus(60, seed=9)]
    rows += [(corpus(1, seed=50 + i)[0], "en", True) for i in range(6)]  # reviewers err
    return abuse.fit_abuse(rows)


def test_abuse(judge, spark):
    clean = corpus(20, seed=77)
    flag = ["The river rose. What a bastard you are.", "You scum coward, I will break your bones. A letter came.", "WHAT A B A S T A R D YOU ARE."]
    s = judge.scores([*clean, *flag, None, ""])
    assert (s[:20] < judge.threshold).mean() > 0.9 and (s[20:23] >= judge.threshold).all() and s[23] == s[24] == 0
    long = judge.scores([" ".join(clean) * 20 + " What a bastard you are."])
    assert long[0] >= judge.threshold
    df = spark.createDataFrame([(1, flag[0], "en", "s"), (2, None, None, None), (None, "x", None, None)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: (r.flagged, r.source) for r in abuse.score_documents(df, judge, keep=("source",)).collect()} == {1: (True, "s"), 2: (False, None)}
    assert abuse.score_documents(df.where("false"), judge).count() == 0


def test_what_a_language_often_has_is_no_abuse():
    rng = random.Random(5)
    rare = lambda: " ".join(f"{rng.choice(['O feitor', 'A viúva', 'O mestre'])} {rng.choice(['vendeu', 'contou', 'viu'])} {rng.choice(['as ovelhas', 'a cevada', 'o farol'])} {rng.choice(['na vila', 'no porto', 'na serra'])}." for _ in range(4))
    ok, bad = corpus(150, seed=4), "What a filthy bastard you are."
    rows = [(t, False) for t in ok[:80]] + [(t, None) for t in ok[80:]] + [(rare(), None) for _ in range(6)]
    rows += [(f"{t} {bad}", True) for t in corpus(40, seed=9)] + [(rare(), True) for _ in range(4)]  # reviewers err in the rare language
    model = abuse.fit_net(rows)
    s = model.scores([rare() for _ in range(20)] + [bad])
    assert s[:20].max() < 0.5 < s[20]


def test_thresholds():
    model = abuse.fit_net([])
    low, high = {("en", b): 90 for b in range(0, 30, 3)}, {("en", b): 5 for b in range(92, 98)}
    model.calibrate({("en", 95): 3}, low | high)
    assert 0.3 < model.threshold < 0.92 and model.limit("en") == pytest.approx(model.threshold, abs=0.1) and model.limit("xx") == model.threshold
    # a language whose flagged documents score lower
    model.calibrate({("en", 95): 300, ("fr", 45): 300}, low | high | {("fr", 45): 40, ("fr", 3): 500})
    assert model.limit("français") <= 0.45 < model.limit("English")
    model.calibrate({}, {})
    assert 0.3 <= model.threshold <= 0.95
