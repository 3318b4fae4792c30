import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pages
from corpusloom.sinks import notes, qdpx, report, tables
from corpusloom.sources import bibliography, codebooks, images, lexicons, markdown
from corpusloom.streaming import ingest


def test_bibliography(spark):
    a = json.dumps({"items": [{"citationKey": "k1", "title": "T", "creators": [{"lastName": "岡", "firstName": "太"}, "Solo", {"name": "Org"}, {}], "date": "ca. 1867", "publicationTitle": "P"}]})
    b = json.dumps([{"id": "k2", "author": [{"family": "Li"}], "issued": {"date-parts": [[1868, 1]]}, "container-title": "C"}, {"key": 3, "year": 1870}])
    got = {r.key: r for r in bibliography.parse_bibliography(spark.createDataFrame([(a,), (b,), ("[]",)], "value string")).collect()}
    assert (got["k1"].authors, got["k1"].year, got["k1"].source) == (["岡　太", "Solo", "Org"], 1867, "P")
    assert (got["k2"].authors, got["k2"].year, got["k2"].source) == (["Li"], 1868, "C") and got["3"].year == 1870


def test_front_matter(spark):
    t = "---\ntitle: 'A: b'\nyear: 1867\nshelf: C-5\nera: null\n---\n\n# 本文\n\nBody [[x|y]]\n"
    src = spark.createDataFrame([(t, "/v/a.md"), ("no matter", "/v/b%20c.md"), ("---\nopen", "/v/c.md")], "value string, file_path string")
    a, b, c = markdown.parse_markdown(src).collect()
    assert (a.title, a.year, a.era, a.extras, a.body, a.links) == ("A: b", 1867, None, {"shelf": "C-5"}, "Body [[x|y]]\n", ["x"])
    assert (b.title, b.body) == ("b c", "no matter") and c.body == "---\nopen"


def test_markdown_files_and_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "A", "me", 1860, "x\ny"), (2, "A", None, None, "z")], "id long, title string, author string, year int, body string")
    out = tmp_path / "vault"
    notes.write_notes(notes.markdown_text(d), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["A 1.md", "A 2.md"] and markdown.is_vault(str(out)) and not markdown.is_vault(str(tmp_path / "none"))
    back = {r.body: r for r in markdown.read_markdown(spark, str(out)).collect()}
    assert back["x\ny\n"].author == "me" and back["x\ny\n"].year == 1860 and back["z\n"].title == "A"
    q = ingest.append_documents(ingest.watch_markdown(spark, str(out)), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_lexicons(spark, tmp_path):
    p = lambda text, form: {r.word: r.polarity for r in lexicons.parse(lexicons.numbered(spark.createDataFrame([(text,)], "t string"), "t"), form).collect()}
    assert p("# c\n優れる:すぐれる:動詞:1\n悪い:わるい:形容詞:-0.9\nx:y:z:bad\n悪い:わるい:形容詞:-0.8", "colon") == {"優れる": 1.0, "悪い": -0.8}
    assert p("良い\tposi\n悪い\tnega\n無\tx", "tab_polarity") == {"良い": 1.0, "悪い": -1.0}
    assert p("ポジ（評価）\t良 い\nネガ\t悪い\nニュ\t良い\nニュ\t並", "verb_phrases") == {"良い": 1.0, "悪い": -1.0, "並": 0.0}
    assert p("夢\tp\n罪\tn\n机\te\n他\ta", "nouns") == {"夢": 1.0, "罪": -1.0, "机": 0.0}
    f = tmp_path / "l.txt"
    f.write_bytes("夢\tp\n".encode("euc-jp"))
    df = lexicons.parse(lexicons.lines(spark, str(f), "euc-jp"), "nouns")
    lexicons.install(df, str(tmp_path / "out"))
    assert lexicons.load(spark, str(tmp_path / "out")).collect()[0].word == "夢"
    with pytest.raises(ValueError):
        lexicons.install(df.where("false"), str(tmp_path / "no"))


XML = '<P xmlns="urn:x"><Codes><Code name="A"><Description> d </Description><Code name="B" color="#fff"/><Code name="C"/></Code><Code name="D"/></Codes></P>'


def test_codebook_xml(spark):
    rows = codebooks.parse_codebooks(spark.createDataFrame([("f", XML)], "source string, value string"))
    got = {r.name: r for r in codebooks.import_codes(rows, 7, 100).collect()}
    assert (got["A"].id, got["B"].parent_id, got["D"].parent_id, got["A"].definition, got["C"].definition) == (100, 100, None, "d", None)


def fixture(spark):
    d = spark.createDataFrame([(1, "T/1", "Hello world", "en")], "id long, title string, body string, language string")
    c = spark.createDataFrame([(1, None, "A & B", None, "#112233", 0), (2, 1, "Sub", "x", None, 1)], "id long, parent_id long, name string, definition string, color string, sort_order int")
    k = spark.createDataFrame([(1, "me", "admin")], "id long, name string, role string")
    s = spark.createDataFrame([(1, 1, 2, 1, 0, 5, "draft"), (2, 1, 1, None, 6, 11, "draft")], "id long, document_id long, code_id long, coder_id long, char_start int, char_end int, status string")
    return d, c, k, s


def test_exports(spark, tmp_path):
    d, c, k, s = fixture(spark)
    f = tmp_path / "s.csv"
    assert tables.write_one_csv(tables.segments_table(s, d, c, k).orderBy("id"), str(f), bom=True) == 2
    text = f.read_bytes().decode("utf-8-sig")
    assert text.startswith("id,document_id,title,code,coder") and text.count("\r\n") == 3 and ",Hello\r\n" in text
    note = notes.vault_notes(d, s, c).first()
    assert note.name == "T_1" and "tags: [A_&_B, Sub]" in note.text and note.text.index("> Hello") < note.text.index("> world")
    z = tmp_path / "p.qdpx"
    qdpx.write_qdpx(str(z), "P", d, s, c, k)
    with zipfile.ZipFile(z) as a:
        root = ElementTree.fromstring(a.read("project.qde"))
        assert len([n for n in a.namelist() if n.startswith("sources/")]) == 1
    ns = {"q": "urn:QDA-XML:project:1.0"}
    assert root.find(".//q:Code/q:Code", ns).get("name") == "Sub" and len(root.findall(".//q:PlainTextSelection", ns)) == 2


def test_drawings(spark):
    t = spark.createDataFrame([("A<", "1860", 2), ("B", "1861", 0)], "name string, value string, n long")
    svg = report.heatmap_svg(t)
    tiles = [e for e in ElementTree.fromstring(svg).iter() if e.tag.endswith("rect") and len(e)]
    assert "A&lt;, 1860: 2" in svg and len(tiles) == 1 and ElementTree.fromstring(report.heatmap_svg(t.where("false"))) is not None
    s = spark.createDataFrame([(1860, 1), (1868, 2)], "year int, n int")
    drawn = ElementTree.fromstring(report.series_svg(s))
    assert [e.text for e in drawn if e.tag.endswith("text")] == ["1860", "1868"] and sum(e.get("class") == "zero" for e in drawn) == 1
    assert len(ElementTree.fromstring(report.series_svg(s.where("false")))) == 0
    nodes = spark.createDataFrame([(1, "A", 0, None), (2, "B", 3, "#fff")], "id long, label string, value long, color string")
    edges = spark.createDataFrame([(1, 2, 2.0, "cooccurrence"), (1, 2, 1.0, "is-a")], "source long, target long, weight double, relation string")
    g = json.loads(report.graph_json(nodes, edges))
    assert g["nodes"][0]["value"] == 1 and sorted(e["label"] for e in g["edges"]) == ["", "is-a"] and "<svg" in report.graph_html(nodes, edges)
    tree = spark.createDataFrame([(1, "A", 0, 1, 2)], "id long, name string, depth int, preorder int, frequency int")
    ex = spark.createDataFrame([(1, "<q>")], "code_id long, example string")
    assert "&lt;q&gt;" in report.html_report("R", {"documents": 1}, tree, fixture(spark)[2], ex)


def test_pages(spark, tmp_path):
    w = spark.createDataFrame([(1, 0, 0, "ab", 0, 0, 50, 20, 0.9), (1, 1, 0, "cd", 60, 0, 50, 18, 0.9), (1, 1, 0, "cd", 60, 0, 50, 18, 0.9), (1, 2, 1, "e", 0, 30, 10, 10, -1.0)], "page_id long, word_index int, line_index int, text string, x int, y int, w int, h int, confidence double")
    a, b = pages.lines_from_words(w).orderBy("line_index").collect()
    assert (a.text, a.x, a.y, a.w, a.h, a.confidence) == ("ab cd", 0, 0, 110, 20, pytest.approx(0.9)) and b.confidence is None
    c = pages.page_confidence(w).first()
    assert c.n_words == 3 and not c.needs_review
    z = tmp_path / "s.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("b.png", b"2")
        f.writestr("a.png", b"1")
        f.writestr("x.txt", b"no")
    p = images.read_pages(spark, str(tmp_path))
    assert [(r.label, bytes(r.content)) for r in p.collect()] == [("s.zip!a.png#p1", b"1"), ("s.zip!b.png#p1", b"2")]

    def engine(content):
        if bytes(content) == b"2":
            raise RuntimeError("bad")
        return [{"text": "t", "x": 0, "y": 0, "w": 1, "h": 1}]

    got = pages.recognise(p, engine).collect()
    assert {r.text or r.error for r in got} == {"t", "RuntimeError: bad"}
    assert pages.best_trial(spark.createDataFrame([(1, "h", 0.5, 1.0), (1, "v", 0.9, 0.1)], "page_id long, setting string, confidence double, share double")).first().setting == "h"
    assert F is not None


def test_drawings_are_for_small_results(spark, monkeypatch):
    monkeypatch.setattr(report, "DRAWN_MOST", 3)
    with pytest.raises(ValueError):
        report.heatmap_svg(spark.range(4).selectExpr("'a' name", "cast(id as string) value", "id n"))


def test_first_examples(spark):
    from corpusloom.operators.coding import first_examples

    d = spark.createDataFrame([(1, "abcdef" * 40)], "id long, body string")
    s = spark.createDataFrame([(3, 1, 7, 0, 200), (2, 1, 7, 3, 9), (1, 1, 7, 5, 5), (4, 1, 8, 0, 0)], "id long, document_id long, code_id long, char_start int, char_end int")
    assert {r.code_id: r.example for r in first_examples(s, d).collect()} == {7: "defabc"}


def test_registered_lexicons_and_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from corpusloom.sources import lexicons

    z = tmp_path / "w.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("README", "nothing")
        f.writestr("dic/wago.121808.pn", "ポジ（経験）\t喜ぶ\nネガ（経験）\t腹 が 立つ\n")
    t = tmp_path / "n.tar.gz"
    with tarfile.open(t, "w:gz") as f:
        data = "名誉\tp\t\n逆賊\tn\t\n机\te\t\n".encode()
        info = tarfile.TarInfo("pn.csv.m3")
        info.size = len(data)
        f.addfile(info, io.BytesIO(data))
    plain = tmp_path / "pn.dic"
    plain.write_bytes("優れる:すぐれる:動詞:1\n悪い:わるい:形容詞:-0.9\n".encode("euc-jp"))
    where = str(tmp_path / "lex")
    get = lambda key, path: {r.word: r.polarity for r in lexicons.install_known(spark, key, str(path), where).collect()}
    assert get("tohoku_wago", z) == {"喜ぶ": 1.0, "腹が立つ": -1.0} and get("tohoku_noun", t) == {"名誉": 1.0, "逆賊": -1.0, "机": 0.0}
    assert lexicons.installed(spark, where) == ["tohoku_wago", "tohoku_noun"] and get("takamura_pn", plain) == {"優れる": 1.0, "悪い": -0.9}
    base = spark.createDataFrame([("名誉", 0.6), ("功", 0.4)], "word string, polarity double")
    both = {r.word: r.polarity for r in lexicons.load_combined(spark, base, where).collect()}
    assert both["名誉"] == 1.0 and both["功"] == 0.4 and len(both) == 8
    with pytest.raises(KeyError):
        lexicons.install_known(spark, "other", str(plain), where)


def test_proposed_settings(spark):
    rows = [
        (1, "ja", False, 0.5, "春の海"), (1, "ja", True, 0.6, "春の海ひねもす"), (1, "en", False, 0.9, "ab"),  # Japanese, downwards
        (2, "ja", True, 0.9, "a春bcde"), (2, "en", False, 0.3, "a letter"),  # too few Han characters
        (3, "ja", False, 0.3, "春の海ひねもす"), (3, "en", False, None, "x"), (3, "de", False, 0.2, "ein Brief"),  # not sure enough
        (4, "ja", False, 0.1, None),
    ]
    t = spark.createDataFrame(rows, "page_id long, language string, vertical boolean, confidence double, text string")
    got = {r.page_id: (r.language, r.vertical, r.label) for r in pages.propose_settings(t).collect()}
    assert got == {1: ("ja", True, "Japanese vertical"), 2: ("en", False, "English horizontal"), 3: ("de", False, "Unknown horizontal"), 4: ("und", False, "Unknown")}
    assert pages.propose_settings(t.where("false")).count() == 0
