"""Blocks of names from all variants of a key."""

import random
import time

from corpusloom.llm.names import block_keys, components, resolve_block, resolve_names


def test_every_variant_finds_its_key(spark):
    def mains(*rows):
        return {r.key: r.main for r in block_keys(spark.createDataFrame(rows, "key string, n long")).collect()}

    # all three share only "abcd", whose commonest key is two slips from the first
    assert mains(("abczd", 1), ("abcyd", 5), ("xabcd", 90)) == {"abczd": "abcyd", "abcyd": "abcyd", "xabcd": "xabcd"}
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx", "abuvwzyx"]
    # short ones need the right form to be much commoner
    assert mains(("hale", 50), ("hlae", 1), ("hals", 20), ("ab", 1), ("abc", 9)) == {"hale": "hale", "hlae": "hale", "hals": "hals", "ab": "ab", "abc": "abc"}
    assert set(mains(*((w, i + 1) for i, w in enumerate(chain))).values()) == {chain[-1]}


def test_components(spark):
    rows = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(21)} | {"x": "x", "y": "x"}


def test_profiles_proved_in_two_blocks_unite(spark):
    # "Bob Zebedon" may have either part for a surname: "Robert Zebedon" is found in one block, "Bob, Z." in the other
    names = ["Bob Zebedon", "Robert Zebedon", "Bob, Z.", "Zebedon Robert"]
    got = {r.name: r.identity for r in resolve_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len({got[n] for n in names[:3]}) == 1


def test_a_large_block_takes_seconds():
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(1500)]
    rows = [([r.choice(base)] if r.random() < 0.8 else [], [r.choice(letters)], "smith", "smith") for _ in range(10_000)]
    t = time.time()
    assert len(resolve_block(rows, dict.fromkeys(base, 20))) == 10_000 and time.time() - t < 20


def test_recall_and_precision_on_made_up_people(spark):
    """People with all their spellings: how many pairs are found, and how many of those found are right."""
    r = random.Random(7)
    syllables = ["tor", "vel", "und", "am", "ble", "quist", "gaard", "lor", "rim", "er", "hol", "stan", "wick", "fen"]
    surnames = sorted({"".join(r.sample(syllables, 3)) for _ in range(90)})
    given = ["Margaret", "Robert", "Edward", "Elizabeth", "William", "Katherine", "Theodore", "Henrietta", "Zacharias", "Isabella"]
    short = {"Margaret": "Peggy", "Robert": "Bob", "William": "Will", "Theodore": "Theo", "Zacharias": "Zach", "Katherine": "Kate"}
    who = {}
    for k, s in enumerate(surnames):
        for g in r.sample(given, 2 if k % 3 else 1):
            s_, m = s.capitalize(), r.choice("ABCDLNPS")
            for n in (f"{g} {s_}", f"{s_}, {g}", f"{g} {m}. {s_}", f"{s_}, {g[0]}. {m}.", f"{s_}, {short.get(g, g)}", f"{g.upper()} {s_.upper()}"):
                who.setdefault(n, set()).add((s, g))
            i = r.randrange(2, len(s) - 2)
            who.setdefault(f"{s_[:i]}{s_[i + 1]}{s_[i]}{s_[i + 2:]}, {g}", set()).add((s, g))
    got = {}
    for x in resolve_names(spark.createDataFrame([(n,) for n in who], "name string")).collect():
        got.setdefault(x.identity, []).append(x.name)
    names = sorted(n for n in who if len(who[n]) == 1)
    true = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if who[a] == who[b]}
    found = {(a, b) for own in got.values() for a in own for b in own if a < b and len(who[a]) == len(who[b]) == 1}
    assert len(true & found) >= 0.95 * len(true) and len(true & found) >= 0.97 * len(found)


def test_han_names(spark):
    names = ["山田太郎", "山田太朗", "山田 太郎", "山田二郎"]
    got = {r.name: r.identity for r in resolve_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len({got[n] for n in names[:3]}) == 1 and got["山田二郎"] != got["山田太郎"]


def test_a_surname_is_no_given_name_of_the_other_reading(spark):
    names = ["Robert Cavibavim", "Cavibavim Robert", "Zacharias Cavibavim", "Cavibavim Zacharias", "zacharias cavibavim", "Cavibavim, Robert E."]
    got = {r.name: r.identity for r in resolve_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len({got[n] for n in names if "obert" in n}) == len({got[n] for n in names if "acharias" in n}) == 1 and len(set(got.values())) == 2
