"""Pages repaired against the whole of what is known."""

from corpusloom.llm import ocr


def test_three_false_readings_in_a_long_word():
    words = {w: (50, w) for w in ("correspondence", "embankment", "the")}
    lex = ocr.Lexicon(words, {})
    spots = sum(len(lex.back.get(low, ())) for w in ("corrcspoudcnce",) for i in range(len(w)) for low in (w[i], w[i : i + 2]))
    assert spots > 14
    assert lex.repair("corrcspoudcnce", 0.6) == "correspondence"
    assert lex.repair("ernbaukmcnt", 0.6) == "embankment"
    assert lex.repair("corrcspoudcncc", 0.6) is None  # four
    assert lex.joined("corrcspou", "dcnce") == "correspondence"


LINES = ["the town of thc embaukmeut and the cmbanknicnt", "of embankmentpasture the town and thc pas-", "turc of the town well", "土地の習わしに従い", "土地の習ねしに従い", "of the"]
WORDS = "page_id long, word_index int, line_index int, text string, x int, y int, w int, h int, confidence double"


def test_rare_entries_of_a_large_lexicon(spark):
    rows = []
    for p in range(3):
        words = [(li, w) for li, line in enumerate(LINES) for w in line.split(" ")]
        rows += [(p, k, li, w, 70 + 60 * k, 0, 50, 20, 0.5) for k, (li, w) in enumerate(words)]
    words = spark.createDataFrame(rows, WORDS)
    pages = spark.createDataFrame([(p, p, 0) for p in range(3)], "page_id long, document_id long, page_index int")
    rare = "embankment pasture 土地の習わしに従い "

    def got(filler):
        typed = spark.createDataFrame([(1, rare), (2, rare)] + [(3 + i, "the town of and well " * 2_000 + "年月の" * 2_000) for i in range(filler)], "id long, body string")
        _, more = ocr.lexicon(typed, "body")
        return {(r.word_index, r.kind, r.repaired) for r in ocr.page_repairs(words, pages, typed).where("page_id = 1").collect()}, more

    small, none = got(1)
    large, more = got(75)  # 750,000 words and 450,000 trigrams: what stands there twice has less than the share
    assert none is None and {r.low for r in more.words.collect()} == {"embankment", "pasture"} and more.trigrams.count() == 8  # one with the letter before
    assert {r for _, _, r in small} >= {"embankment", "pasture", "土地の習わしに従い"}
    assert large == small


def test_chain_passes_against_all_paths():
    from itertools import product

    import numpy as np

    from corpusloom.llm.chain import marginals

    rng = np.random.default_rng(1)
    sizes, k = np.array([4, 1, 3]), 3
    e, moves, first = rng.normal(0, 2, (3, 4, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    node, edge = marginals(e, moves, first, sizes)
    want = np.zeros((k, k))
    for s, n in enumerate(sizes):
        paths = list(product(range(k), repeat=n))
        p = np.array([np.exp(first[x[0]] + sum(e[s, t, x[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(x, x[1:]))) for x in paths])
        p /= p.sum()
        for t in range(n):
            assert np.allclose([sum(q for q, x in zip(p, paths) if x[t] == j) for j in range(k)], node[s, t])
        for q, x in zip(p, paths):
            for a, b in zip(x, x[1:]):
                want[a, b] += q
    assert np.allclose(edge, want) and (node[1, 1:] == 0).all()


def test_chain_learns_from_partly_known_sequences():
    import random

    from corpusloom.llm.chain import fit_chain

    rng = random.Random(2)
    seqs, known, truth = [], [], []
    for _ in range(200):
        states = [0] + [1] * rng.randint(2, 4) + [2]
        # the features of the first and last item are those of the middle in one case of three: only their place tells
        rows = [[f"f={s if rng.random() < 0.67 else 1}"] for s in states]
        seqs.append(rows)
        truth.append(states)
        known.append([{s} if rng.random() < 0.3 else {0, 1, 2} for s in states])
    chain = fit_chain(seqs, known, 3)
    right = [a == b for rows, states in zip(seqs, truth) for a, b in zip(chain.best(rows), states)]
    assert sum(right) > 0.93 * len(right)
    assert fit_chain([], [], 3).best([["unseen"]]) == [0]


def test_misread_titles(spark):
    import random

    from corpusloom.llm import ocr

    rng = random.Random(5)
    titles = ["".join(rng.choice("abcdeiou nrst") for _ in range(rng.randint(8, 30))).strip() for _ in range(150)]
    lines = {"ab", "some line of the text that is like none"}
    for t in titles:
        c = list(t)
        for _ in range(rng.randint(0, 6)):
            c[rng.randrange(len(c))] = rng.choice("xyz")
        lines.add("".join(c))
    gram = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}
    want = {x for x in lines if len(gram(x)) >= 6 and any(2 * len(gram(x) & gram(t)) >= 0.7 * (len(gram(x)) + len(gram(t))) for t in titles)}
    df = lambda x: spark.createDataFrame([(t,) for t in x], "key string")
    assert {r.key for r in ocr.misread_titles(df(lines), df(set(titles))).collect()} == want and 20 < len(want) < len(lines)
    assert ocr.misread_titles(df(lines), df(["x"]).where("false")).count() == 0
