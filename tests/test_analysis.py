import random
import re
from collections import Counter

import pytest

from corpusloom.operators import coding, collaboration, cooccurrence, sentiment
from corpusloom.operators.search import SearchSpec, search

SEG = "id long, document_id long, code_id long, char_start int, char_end int"


def codes(spark, n=5):
    return spark.createDataFrame([(i, 1) for i in range(1, n + 1)], "id long, project_id long")


def matrix(spark, rows, **kw):
    m = cooccurrence.pair_matrix(spark.createDataFrame(rows, SEG), codes(spark), **kw)
    return {(r.code_a, r.code_b): r.n for r in m.collect()}


def test_scopes(spark):
    rows = [(1, 1, 1, 0, 5), (2, 1, 2, 3, 8), (3, 1, 3, 20, 25)]
    assert matrix(spark, rows) == {(1, 2): 1}
    gap = [(1, 1, 1, 0, 5), (2, 1, 2, 15, 20)]
    assert matrix(spark, gap, scope="distance", distance=15) == {(1, 2): 1} and matrix(spark, gap, scope="distance", distance=5) == {}
    d = spark.createDataFrame([(1, "aaaa\n\nbbbb")], "id long, body string")
    par = [(1, 1, 1, 0, 2), (2, 1, 2, 2, 4), (3, 1, 3, 7, 9)]
    assert matrix(spark, par, scope="paragraph", documents=d) == {(1, 2): 1}
    with pytest.raises(ValueError):
        matrix(spark, rows, scope="page")


@pytest.mark.parametrize(("scope", "distance"), [("overlap", 0), ("distance", 30), ("distance", 700)])
def test_pairs_against_brute_force(spark, scope, distance):
    rng = random.Random(distance)
    rows = []
    for i in range(250):
        a = rng.randrange(2000)
        rows.append((i, rng.randrange(2), rng.randrange(1, 6), a, a + rng.randrange(1, rng.choice([10, 900]))))
    want = Counter()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            gap = max(x[3], y[3]) - min(x[4], y[4])
            if x[1] == y[1] and x[2] != y[2] and (gap < 0 if scope == "overlap" else max(0, gap) <= distance):
                want[min(x[2], y[2]), max(x[2], y[2])] += 1
    assert matrix(spark, rows, scope=scope, distance=distance) == dict(want)


def test_layers(spark):
    rows = [(1, 1, 1, 0, 10), (2, 1, 1, 5, 15), (3, 1, 1, 12, 20), (4, 1, 1, 30, 40)]
    got = {r.id: r.layer for r in coding.layers(spark.createDataFrame(rows, SEG)).collect()}
    assert got[1] == got[3] != got[2] and max(got.values()) == 1


def test_layers_of_many_runs(spark, monkeypatch):
    import random

    monkeypatch.setattr(coding, "LAYER_ROWS", 7)
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), 1, a, a + rng.randrange(1, 15)) for i in range(120) for a in [rng.randrange(0, 400)]]
    got = {r.id: r.layer for r in coding.layers(spark.createDataFrame(rows, SEG)).collect()}
    want = {}
    for d in (1, 2, 3):
        ends = []
        for i, _, _, a, z in sorted((r for r in rows if r[1] == d), key=lambda r: (r[3], r[4], r[0])):
            if all(e <= a for e in ends):
                ends = []
            free = sorted((e, k) for k, e in enumerate(ends) if e <= a)
            k = free[0][1] if free else len(ends)
            ends[k : k + 1] = [z]
            want[i] = k
    assert got == want
    assert coding.layers(spark.createDataFrame([], SEG)).count() == 0


def test_suggestion(spark):
    ex = spark.createDataFrame([(1, "a", "rice tax paid"), (1, "b", "rice tax due"), (2, "c", "the sea and ships")], "code_id long, k string, text string")
    v = coding.gram_vectors(ex.select("k", "text"), "k", "text").join(ex.select("k", "code_id"), "k")
    c = coding.centroids(v, "code_id", "k")
    q = coding.gram_vectors(spark.createDataFrame([("q", "rice taxes"), ("e", "")], "q string, text string"), "q", "text")
    top = coding.top_suggestions(coding.cosine(q, "q", c, "code_id"), "q").collect()
    assert [(r.q, r.code_id) for r in top if r["rank"] == 1] == [("q", 1)]


LEX = sentiment.Lexicon("t", "en", {"good": 0.8, "bad": -0.6, "plain": 0.0}, frozenset({"not"}))


def scores(spark, texts, lex=LEX):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.polarity for r in sentiment.score(df, "t", lex).orderBy("id").collect()]


def test_sentiment(spark):
    got = scores(spark, ["good", "not a good thing", "Good bad", "isn't good", None, "", "plain good"])
    assert got == pytest.approx([0.8, -0.8, 0.1, -0.8, 0.0, 0.0, 0.4])
    ja = sentiment.Lexicon("j", "ja", {"忠": 0.5, "忠義": 0.7, "善": 0.6}, frozenset({"ない"}))
    assert scores(spark, ["忠義", "善ではない", "忠 義"], ja) == pytest.approx([0.7, -0.6, 0.5])
    big = spark.createDataFrame([(1, "not good"), (2, "x")], "id long, t string")
    lex = spark.createDataFrame(list(LEX.words.items()), "word string, polarity double")
    assert {r.id: r.polarity for r in sentiment.score_large(big, "id", "t", lex, ["not"]).collect()} == {1: -0.8, 2: 0.0}
    merged = LEX.merge(sentiment.Lexicon("u", "en", {"good": 0.1}, frozenset({"no"})))
    assert merged.words["good"] == 0.1 and merged.negations == {"not", "no"} and merged.name == "t+u"
    with pytest.raises(ValueError):
        sentiment.units(big.selectExpr("id", "t body"), "word")


def test_workflow_and_locks(spark):
    s = spark.createDataFrame([(1, "draft"), (2, "draft"), (3, "confirmed")], "id long, status string")
    e = spark.createDataFrame([(1, 1, "admin", "approve"), (1, 2, "admin", "confirm"), (2, 1, "coder", "approve"), (2, 2, "admin", "confirm"), (3, 1, "admin", "reject")], "segment_id long, at int, role string, action string")
    assert {r.id: (r.status, r.n_applied) for r in collaboration.fold_workflow(s, e).collect()} == {1: ("confirmed", 2), 2: ("draft", 0), 3: ("draft", 1)}
    log = spark.createDataFrame([(1, 1, 1, "acquire"), (1, 2, 2, "acquire"), (1, 2, 3, "release"), (2, 1, 1, "acquire"), (2, 9, 2, "force"), (3, 4, 1, "acquire"), (3, 4, 2, "release")], "document_id long, coder_id long, at int, kind string")
    assert {(r.document_id, r.coder_id) for r in collaboration.lock_state(log).collect()} == {(1, 1)}


def test_sync(spark):
    d = spark.createDataFrame([(1, 1, "T")], "id long, project_id long, title string")
    c = spark.createDataFrame([(1, 1, "C")], "id long, project_id long, name string")
    s = spark.createDataFrame([(1, 1, 1, 1, 0, 5, "draft")], "id long, document_id long, code_id long, coder_id long, char_start int, char_end int, status string")
    rec = spark.createDataFrame([("T", "C", "C", 0, 5, None), ("T", "C", "C", 0, 6, "draft"), ("X", "C", "C", 0, 5, "draft"), ("T", "new", "C", 1, 2, "draft"), ("T", "new", "C", 1, 2, "reviewed")], "doc string, code string, coder string, start int, end int, status string")
    got = Counter(r.outcome for r in collaboration.classify_records(rec, d, c, c, s, 1).collect())
    assert got == {"skipped": 1, "added": 2, "missing_document": 1, "conflict": 1}


def test_search(spark):
    d = spark.createDataFrame(
        [(1, 1, "Stop-Now", "the café", "A", 1860, "e", "en", 0.5), (2, 1, "x", "Meiji の世", None, None, None, "ja", None), (3, 2, None, None, "b_c", 1870, None, None, None)],
        "id long, project_id long, title string, body string, author string, year int, era string, language string, confidence double",
    )
    s = spark.createDataFrame([(1, 1)], "id long, document_id long")
    f = lambda **k: [r.id for r in search(d, s, SearchSpec(**k)).collect()]
    assert f(query="stop now") == [1] and f(query="cafe") == [1] and f(query="eiji") == [2] and f(query="fé") == [1]
    assert f(year_min=1865) == [3] and f(coded=True) == [1] and f(author="B_") == [3] and f(order_by="nonsense") == [1, 2, 3] and f(order_by="year", descending=True) == [3, 1, 2]
    assert f(query="  ") == [1, 2, 3] and f(query="!?-") == []


def test_import_creates_what_is_missing(spark):
    d = spark.createDataFrame([(1, 1, "T"), (2, 2, "U")], "id long, project_id long, title string")
    c = spark.createDataFrame([(1, 1, "C"), (7, 2, "z")], "id long, project_id long, name string")
    k = spark.createDataFrame([(4, 1, "K")], "id long, project_id long, name string")
    s = spark.createDataFrame([(9, 1, 1, 4, 0, 5, "draft")], "id long, document_id long, code_id long, coder_id long, char_start int, char_end int, status string")
    rec = spark.createDataFrame(
        [("T", "z", "K", 0, 6, "draft"), ("T", "a", "new", 1, 2, None), ("T", "C", "K", 0, 5, "reviewed"), ("U", "q", "K", 0, 1, "draft"), ("V", "q", "K", 0, 1, "draft"), ("V", "q", "K", 1, 2, "draft"), (None, "q", "K", 0, 1, "draft")],
        "doc string, code string, coder string, start int, end int, status string",
    )
    for prefer, status in (("existing", "draft"), ("incoming", "reviewed")):
        got = collaboration.import_records(rec, d, c, k, s, 1, prefer)
        assert {(r.id, r.project_id, r.name) for r in got.codes.collect()} == {(1, 1, "C"), (7, 2, "z"), (8, 1, "a"), (9, 1, "z")}
        assert {(r.id, r.name) for r in got.coders.collect()} == {(4, "K"), (5, "new")}
        assert {(r.doc, r.n_records) for r in got.missing.collect()} == {("U", 1), ("V", 2)}
        rows = {(r.id, r.code_id, r.coder_id, r.char_start, r.char_end, r.status) for r in got.segments.collect()}
        assert rows == {(9, 1, 4, 0, 5, status), (10, 8, 5, 1, 2, "draft"), (11, 9, 4, 0, 6, "draft")}
    empty = collaboration.import_records(rec.where("false"), d, c, k, s, 1)
    assert (empty.codes.count(), empty.segments.count(), empty.missing.count()) == (2, 1, 0)


def test_numbers_do_not_depend_on_partitions(spark):
    from corpusloom.session import number

    df = spark.range(1000).selectExpr("cast(xxhash64(id) as string) k")
    a, b = ({r.k: r.id for r in number(df.repartition(n), ["k"], 5).collect()} for n in (2, 7))
    assert a == b and sorted(a.values()) == list(range(5, 1005)) and [k for k, _ in sorted(a.items(), key=lambda x: x[1])] == sorted(a)
    assert number(df.where("false"), ["k"], 1).count() == 0


def test_readers_of_languages(spark):
    lex = (sentiment.builtin("en"), sentiment.builtin("ja"))
    rows = [(1, "English", "Great peace"), (2, "jpn", "名誉ではない"), (3, None, "not good"), (4, "", "勝利"), (5, "fr", "good"), (6, "en-GB", None)]
    d = spark.createDataFrame(rows, "id long, language string, body string")
    got = {r.document_id: (r.polarity, r.dictionary) for r in sentiment.analyze(d, "document", lex).collect()}
    assert {k: round(v[0], 3) for k, v in got.items()} == {1: 0.7, 2: -0.6, 3: -0.7, 4: 0.7, 5: 0.0, 6: 0.0}
    assert got[2][1] == "builtin-ja" and got[5][1] == "empty"


def test_tokens_of_a_callable(spark):
    d = spark.createDataFrame([(1, "良い 事 ない"), (2, "ない 事 良い"), (3, None)], "id long, t string")
    cut = lambda t: [(w, 0) for w in t.split()]
    ja = sentiment.builtin("ja")
    assert [r.polarity for r in sentiment.score_tokens(d, "t", ja, cut).orderBy("id").collect()] == pytest.approx([-0.6, 0.6, 0.0])
    en = spark.createDataFrame([(1, "never a good day")], "id long, t string")
    assert sentiment.score_tokens(en, "t", sentiment.builtin("en"), cut).first().polarity == pytest.approx(-0.7)


def test_large_scan_is_the_plain_scan(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("忠義善悪功罪無") for _ in range(rng.randint(1, 4))) for _ in range(300)})
    lex = sentiment.Lexicon("x", "ja", {w: round(rng.uniform(-1, 1), 2) for w in words}, frozenset({"無"}))
    rows = [(i, "".join(rng.choice("忠義善悪功罪無の、") for _ in range(n))) for i, n in enumerate([0, 1, 5, 255, 256, 257, 700])] + [(99, None)]
    d = spark.createDataFrame(rows, "id long, t string")
    few = {r.id: (round(r.polarity, 9), r.n_positive, r.n_negative, r.n_words) for r in sentiment.score(d, "t", lex).collect()}
    many = {r.id: (round(r.polarity, 9), r.n_positive, r.n_negative, r.n_words) for r in sentiment.score_large(d, "id", "t", lex.frame(spark), ["無"], "ja").collect()}
    assert few == many
    # 55,000 words: no literal of them in the plan
    big = spark.range(55_000).selectExpr("concat('語', cast(id as string)) word", "0.5D polarity").unionByName(lex.frame(spark))
    out = sentiment.score_large(d, "id", "t", big, ["無"], "ja")
    assert "語123" not in out._jdf.queryExecution().toString() and {r.id: r.n_words for r in out.collect()} == {k: v[3] for k, v in few.items()}


@pytest.mark.parametrize("entries", [100, 1])
def test_exploded_texts_are_never_broadcast(spark, tmp_path, monkeypatch, entries):
    """A text explodes into hundreds of rows that Spark estimates by the size of the file; only the lexicon may be broadcast."""
    monkeypatch.setattr(sentiment, "BROADCAST_ENTRIES", entries)
    spark.range(300).selectExpr("id", "repeat('not good, ', 200) en", "repeat('忠義無、善、、、、', 200) ja").write.parquet(f"{tmp_path}/texts")
    d = spark.read.parquet(f"{tmp_path}/texts")
    ja = sentiment.Lexicon("t", "ja", {"忠義": 0.5, "善": 0.25})
    for lex, negations, want in ((LEX, ["not"], (-0.8, 0, 200, 200)), (ja, ["無"], (-0.125, 200, 200, 400))):
        out = sentiment.score_large(d, "id", lex.language, lex.frame(spark), negations, lex.language)
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and bool(re.search(r"BroadcastHashJoin \[\w+#\d+\], \[_w#", plan)) == (entries > 1)
        assert len(got) == 300 and {(round(r.polarity, 9), r.n_positive, r.n_negative, r.n_words) for r in got} == {want}


def test_records_of_the_log(spark):
    log = spark.createDataFrame([(3, 1, "segment", 1, "add", None, None)], "id long, coder_id long, entity string, entity_id long, action string, detail_json string, created_at timestamp")
    new = spark.createDataFrame([(1, "segment", 2, "add", {"a": "b"}), (None, "segment", 1, "add", {}), (2, "code", 1, "add", None)], "coder_id long, entity string, entity_id long, action string, detail map<string,string>")
    out = collaboration.record(log, new)
    got = {r.id: (r.entity, r.entity_id, r.detail_json, r.created_at is not None) for r in out.collect()}
    assert got == {3: ("segment", 1, None, False), 4: ("code", 1, None, True), 5: ("segment", 1, None, True), 6: ("segment", 2, '{"a":"b"}', True)}
    k = spark.createDataFrame([(1, 7), (2, 8)], "id long, project_id long")
    assert {(r.id, r.project_id) for r in collaboration.of_project(out, k).collect()} == {(3, 7), (4, 8), (6, 7)} and collaboration.of_project(out, k, 8).count() == 1


def test_editing_of_codes_relations_and_words(spark):
    from corpusloom.operators import editing

    c = spark.createDataFrame([(1, 1, None, "A", None, 0, "#111111"), (2, 1, 1, "B", None, None, None)], "id long, project_id long, parent_id long, name string, definition string, sort_order int, color string")
    new = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, None, "r"), (1, 1, "a")], "project_id long, parent_id long, name string")
    got = {r.name: (r.id, r.parent_id, r.sort_order, r.color is not None) for r in editing.create_codes(c, new).collect()}
    assert got["r"] == (3, None, 1, True) and got["a"] == (4, 1, 0, True) and got["b"] == (5, 1, 1, True) and got["B"][3]
    with pytest.raises(Exception, match="needs a name"):
        editing.create_codes(c, new.selectExpr("project_id", "parent_id", "' ' name")).collect()
    assert {r.id: (r.name, r.color) for r in editing.update_rows(c, 1, name="Z", color=None).collect()} == {1: ("Z", "#111111"), 2: ("B", None)}
    r = spark.createDataFrame([(4, 1, 1, 2, "is-a", 1.0)], "id long, project_id long, code_a_id long, code_b_id long, relation_type string, weight double")
    add = spark.createDataFrame([(1, 2, 3, "part-of")], "project_id long, code_a_id long, code_b_id long, relation_type string")
    both = editing.add_relations(r, add)
    assert [(x.id, x.weight) for x in editing.relations_of(both, 1).collect()] == [(4, 1.0), (5, 1.0)] and editing.relations_of(both, 1, "part-of").count() == 1
    for bad in ("project_id", "code_a_id", "code_a_id as code_b_id", "relation_type"), ("project_id", "code_a_id", "code_b_id", "'' as relation_type"):
        with pytest.raises(Exception, match="relation"):
            editing.add_relations(r, add.selectExpr(*bad)).collect()
    assert editing.remove_relations(both, spark.createDataFrame([(4,)], "id long")).count() == 1
    w = spark.createDataFrame([(1, "a", None, 0.1), (1, "a", "ja", 0.2)], "project_id long, word string, language string, polarity double")
    w = editing.set_words(w, spark.createDataFrame([(1, "a", None, 0.9)], w.schema))
    assert {(x.language, x.polarity) for x in w.collect()} == {(None, 0.9), ("ja", 0.2)}
    assert [x.language for x in editing.remove_words(w, spark.createDataFrame([(1, "a", None)], "project_id long, word string, language string")).collect()] == ["ja"]
    k = spark.createDataFrame([(1, "coder")], "id long, role string")
    assert editing.set_roles(k, k.selectExpr("id", "'admin' role"), collaboration.ROLES).first().role == "admin"
    with pytest.raises(Exception, match="unknown role"):
        editing.set_roles(k, k.selectExpr("id", "'king' role"), collaboration.ROLES).collect()


def test_training_lists(spark):
    from corpusloom.operators import agreement

    u = spark.createDataFrame([(1, i, i + 1) for i in range(6)], "document_id long, us int, ue int")
    s = spark.createDataFrame([(1, 1, 9, 0, 4), (1, 2, 9, 2, 6), (1, 3, 9, 0, 6)], "document_id long, coder_id long, code_id long, char_start int, char_end int")
    d = spark.createDataFrame([(1, "abcdef")], "id long, body string")
    assert {(r.text, r.kind) for r in agreement.training_lists(u, s, d, 1, 2).collect()} == {("a", "missed"), ("b", "missed"), ("e", "extra"), ("f", "extra")}


def test_preorder_and_places(spark):
    from corpusloom.operators.hierarchy import preorder
    from corpusloom.operators.search import collection_sizes, document_collections

    c = spark.createDataFrame([(1, None, 1, 7), (2, None, 0, 7), (3, 1, None, 7), (4, 1, 0, 9), (5, 5, 0, 7), (3, 1, None, 7)], "id long, parent_id long, sort_order int, project_id long")
    assert [r.id for r in preorder(c).orderBy("place").collect()] == [2, 1, 3, 4]
    m = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 2)], "document_id long, collection_id long")
    k = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert {(r.collection_id, r.n) for r in collection_sizes(k, m).collect()} == {(1, 2), (2, 0)}
    assert {(r.document_id, r.name) for r in document_collections(m.where("document_id = 1"), k).collect()} == {(1, "a")}
