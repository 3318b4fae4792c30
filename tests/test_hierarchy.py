import random

import pytest

from corpusloom.operators import editing
from corpusloom.operators.hierarchy import descendant_counts, descendants, resolve_hierarchy

SCHEMA = "id long, parent_id long"


def brute(parents):
    out = {}
    for i in parents:
        up, seen = [i], {i}
        cyc = None
        while parents[up[-1]] in parents:
            n = parents[up[-1]]
            if n in seen:
                cyc = min(up[up.index(n) :])
                break
            up.append(n)
            seen.add(n)
        out[i] = (None, None, None, cyc) if cyc is not None else (up[-1], len(up) - 1, tuple(reversed(up)), None)
    return out


def solve(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: (r.root_id, r.depth, tuple(r.path) if r.path else None, r.cycle_id) for r in resolve_hierarchy(df, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    n = 300
    ids = rng.sample(range(1, 10_000), n)
    parents = {}
    for k, i in enumerate(ids):
        r = rng.random()
        parents[i] = None if r < 0.1 else 999_999 if r < 0.13 else i if r < 0.15 else ids[k - 1] if r < 0.6 and k else rng.choice(ids)
    rows = list(parents.items()) * 2
    rng.shuffle(rows)
    assert solve(spark, rows) == brute(parents)


def test_deep_chain_and_loop_without_splitters(spark):
    chain = [(i, i - 1 if i else None) for i in range(700)]
    loop = [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)]
    got = solve(spark, chain + loop, splitter_every=1 << 40)
    assert got[699][1] == 699 and got[699][2][0] == 0
    assert {i: got[i][3] for i in (1000, 1001, 1002, 1003)} == dict.fromkeys((1000, 1001, 1002, 1003), 1000)


def test_edges(spark):
    assert solve(spark, []) == {}
    assert solve(spark, [(None, 1), (1, None), (1, None), (2, 1), (2, 1), (3, 77)]) == {1: (1, 0, (1,), None), 2: (1, 1, (1, 2), None), 3: (3, 0, (3,), None)}
    assert solve(spark, [(5, 5)], paths=False) == {5: (None, None, None, 5)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7, "x"), (2, 1, 8, "y")], "id long, parent_id long, tgt int, path string")
    assert {r.id: r.depth for r in resolve_hierarchy(df).collect()} == {1: 0, 2: 1}


def test_descendants(spark):
    tree = resolve_hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], SCHEMA))
    assert {(r.ancestor_id, r.id, r.distance) for r in descendants(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    assert {r.id: r.n_descendants for r in descendant_counts(tree).collect()} == {1: 3, 2: 1, 3: 0, 4: 0}


def test_move_and_delete(spark):
    codes = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (4, None, 1)], "id long, parent_id long, sort_order int")
    seg = spark.createDataFrame([(1, 3), (2, 4)], "id long, code_id long")
    left, kept = editing.delete_codes(codes, seg, [2])
    assert {r.id for r in left.collect()} == {1, 4} and [r.id for r in kept.collect()] == [2]
    with pytest.raises(editing.CycleError):
        editing.move_code(codes, 1, 3)
    moved = {r.id: (r.parent_id, r.sort_order) for r in editing.move_code(codes, 4, 1).collect()}
    assert moved[4] == (1, 1)


def test_many_small_loops_and_a_long_one(spark):
    n = 20_000
    small = [(i, i ^ 1) for i in range(n)]
    tails = [(n + i, i if i % 2 else None) for i in range(200)]
    ring = [(10**6 + i, 10**6 + (i + 1) % 3000) for i in range(3000)]
    got = solve(spark, small + tails + ring)
    assert all(got[i][3] == i & ~1 for i in range(n)) and all(got[i][3] == 10**6 for i, _ in ring)
    assert all(got[n + i][3] == (i - 1 if i % 2 else None) for i in range(200))


def test_trails_of_loops_stay_short(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import hierarchy

    longest = []
    walk = hierarchy._walk

    def watched(start, stops):
        out = walk(start, stops)
        longest.append(out.agg(F.sum(F.size("trail"))).first()[0] or 0)
        return out

    hierarchy._walk = watched
    try:
        solve(spark, [(i, i ^ 1) for i in range(2000)] + [(10_000 + i, 10_000 + (i + 1) % 2000) for i in range(2000)])
    finally:
        hierarchy._walk = walk
    assert max(longest) < 4000 * 20
