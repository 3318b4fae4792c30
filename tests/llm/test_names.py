import pytest

from corpusloom.llm.names import one_slip, parse, resolve_block, resolve_names, spelling_pairs


def test_slips():
    assert one_slip("smith", "smiht") and one_slip("smith", "smth") and one_slip("smith", "smitth") and one_slip("smith", "smyth")
    assert not one_slip("smith", "smhti") and not one_slip("ab", "abcd")


@pytest.mark.parametrize("name", ["Anon.", "[s.n.]", "N. N.", "unknown", "著者不詳", "?"])
def test_placeholders(name):
    assert parse(name)[0] == "none"


def test_forms():
    assert parse("Dr. Jane Q. Doe (ed.)")[:4] == ("person", "", ["jane", "doe"], ["q"])
    assert parse("Doe, Jane")[4] == 0 and parse("J.Q. Doe")[3] == ["j", "q"] and parse("Doe　Jane")[4] == 0
    assert parse("Hist. Soc. of Elbury")[:3] == parse("The Elbury Historical Society")[:3]
    assert parse("櫻井 太郎 著")[:2] == parse("桜井太郎")[:2] == parse("桜井, 太郎氏")[:2]


def test_merge_and_rematch():
    k = "doe"
    r = [(["edmund"], ["r"], k, k), ([], ["e", "r"], k, k), (["elizabeth"], [], k, k), ([], ["e"], k, k), (["ned"], [], k, k), (["edmnud"], [], k, k)]
    c = resolve_block(r, {"edmund": 50, "elizabeth": 50})
    assert c[0] == c[1] == c[4] == c[5] and c[2] != c[0] and c[3] not in (c[0], c[2])
    # two people of one name with different initials stay apart, and the bare name goes to neither
    c = resolve_block([(["ann"], ["b"], k, k), (["ann"], ["c"], k, k), (["ann"], [], k, k)], {"ann": 9})
    assert len(set(c)) == 3
    # names of their own one letter apart
    assert len(set(resolve_block([(["maria"], [], k, k), (["marie"], [], k, k)], {"maria": 40, "marie": 30}))) == 2


SPELLINGS = [
    "Margaret Torvelund", "Torvelund, Margaret", "M. Torvelund", "Torvelund Margaret", "Margaret Torvelnud", "margaret torvelund", "Peggy Torvelund", "Robert Torvelund",
    "Margaret Quistgaard", "Margaret Ambleside", "Robert Ambleside", "Robert Quistgaard", "Margaret Lorrimer", "Robert Lorrimer",
    "Elbury Historical Society", "Elbury Hist. Soc.", "Historical Society, Elbury", "Elbury Record Commission", " Margaret Torvelund ", "", None, "Anon.",
]


def test_resolution(spark):
    df = spark.createDataFrame([(s, 1, "x") for s in SPELLINGS + SPELLINGS[:5]], "name string, identity int, key string")
    got = {r.name: r.identity for r in resolve_names(df).collect()}
    me = {"Margaret Torvelund", "Torvelund, Margaret", "M. Torvelund", "Torvelund Margaret", "Margaret Torvelnud", "margaret torvelund", "Peggy Torvelund"}
    assert {n for n, i in got.items() if i == got["Margaret Torvelund"]} == me
    assert len({got[n] for n in ("Elbury Historical Society", "Elbury Hist. Soc.", "Historical Society, Elbury")}) == 1 and got["Elbury Record Commission"] != got["Elbury Historical Society"]
    assert "Anon." not in got and "" not in got and len(got) == 18
    p = {(r.name_a, r.name_b) for r in spelling_pairs(resolve_names(df)).collect()}
    assert len(p) == 7 * 6 // 2 + 3 and all(a < b for a, b in p)
    assert resolve_names(df.where("false")).count() == 0
