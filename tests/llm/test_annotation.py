import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import consensus, pairs


def simulate(seed=0, n=400, coders=8, k=5):
    rng = random.Random(seed)
    theta = {c: 0.9 if c < 4 else 0.1 for c in range(coders)}
    rows, truth = [], {}
    for u in range(n):
        truth[u] = rng.randrange(k)
        for c in rng.sample(range(coders), 5):
            code = truth[u] if rng.random() < theta[c] else (0 if rng.random() < 0.8 else rng.randrange(k))
            rows.append((u, c, code, 1))
    return rows, truth


def test_mixture_beats_the_majority(spark):
    rows, truth = simulate()
    lab = spark.createDataFrame(rows + rows[:50] + [(None, 1, 1, 1), (1, None, 1, 1)], "unit_id long, coder_id long, code_id long, space long")
    post, coders = consensus.fit_competence(lab)
    got = {r.unit_id: r for r in consensus.consensus(lab, post, min_coders=3).collect()}
    votes = {}
    for u, _, c, _ in rows:
        votes.setdefault(u, Counter())[c] += 1
    majority = sum(min(v, key=lambda c: (-v[c], c)) == truth[u] for u, v in votes.items()) / len(truth)
    mixture = sum(got[u].code_id == truth[u] for u in truth) / len(truth)
    assert mixture > majority + 0.1 and mixture > 0.9
    comp = {r.coder_id: r.competence for r in coders.collect()}
    assert min(comp[c] for c in range(4)) > 0.75 > 0.4 > max(comp[c] for c in range(4, 8))
    assert all(0 <= r.agreement <= 1 and 0 <= r.confidence <= 1 for r in got.values())


def test_consensus_edges(spark):
    s = "unit_id long, coder_id long, code_id long, space long"
    lab = spark.createDataFrame([(1, 1, 5, 1), (2, 1, 5, 1), (2, 2, 6, 1)], s)
    post, _ = consensus.fit_competence(lab)
    got = {r.unit_id: r for r in consensus.consensus(lab, post).collect()}
    assert got[1].agreement is None and got[1].code_id == 5 and got[2].agreement == 0
    assert consensus.consensus(lab, post, min_coders=2).count() == 1
    with pytest.raises(RuntimeError):
        consensus.fit_competence(lab, most=1, tolerance=1e-12)
    post, coders = consensus.fit_competence(lab.where("false"))
    assert post.count() == coders.count() == 0


def test_span_labels(spark):
    u = spark.createDataFrame([(1, 1, 0, 300), (2, 1, 310, 900), (3, 2, 0, 5), (4, 2, 7, 7)], "unit_id long, document_id long, char_start int, char_end int")
    s = spark.createDataFrame(
        [(1, 1, 7, 1, 2, 305), (1, 1, 7, 1, 2, 305), (2, 1, 7, 2, 290, 500), (3, 1, 8, 3, 301, 309), (4, 2, 8, 1, 4, 99), (5, 2, None, 1, 0, 4), (6, None, 7, 1, 0, 4)],
        "id long, document_id long, code_id long, coder_id long, char_start int, char_end int",
    )
    assert {(r.unit_id, r.coder_id, r.code_id) for r in consensus.span_labels(s, u).collect()} == {(1, 1, 7), (2, 2, 7), (3, 1, 8)}


def test_pair_counts_with_wide_baskets(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(1 + b % 2, b, i) for b in range(30) for i in rng.sample(range(25), rng.choice([1, 3, 15]))]
    want, n_item = Counter(), Counter()
    for b in range(30):
        items = sorted({i for _, x, i in rows if x == b})
        want.update((1 + b % 2, x, y) for x, y in combinations(items, 2))
        n_item.update((1 + b % 2, i) for i in items)
    df = spark.createDataFrame(rows + rows[:40] + [(None, 1, 1), (1, None, 1), (1, 1, None)], "g long, b long, i long")
    got = {(r.g, r.a, r.b): r for r in pairs.surprising_pairs(df, "g", "b", "i").collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(want)
    assert all((r.n_a, r.n_b, r.n) == (n_item[g, a], n_item[g, b], 15) and -300 <= r.log10_p <= 0 < r.q_value <= 1 for (g, a, b), r in got.items())
    assert pairs.surprising_pairs(df.where("false"), "g", "b", "i").count() == 0


def test_null_model_keeps_both_margins():
    k, mk, d, md = np.array([2.0, 5.0, 9.0]), np.array([10.0, 4.0, 2.0]), np.array([1.0, 3.0, 8.0]), np.array([10.0, 8.0, 3.0])
    assert (k * mk).sum() == (d * md).sum()
    x, y = pairs.fit_classes(k, mk, d, md)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert (p * md).sum(1) == pytest.approx(k, rel=1e-5) and (p * mk[:, None]).sum(0) == pytest.approx(d, rel=1e-5)


def test_null_model_with_full_items_and_baskets():
    x, y = pairs.fit_classes(np.array([3.0, 20.0]), np.array([5.0, 1.0]), np.array([1.0, 6.0]), np.array([17.0, 3.0]))
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert p[1] == pytest.approx([1, 1], abs=1e-3) and np.isfinite(p).all()


def test_tails_against_exact_convolution():
    q, m = np.array([[0.02, 0.1, 0.4], [0.01, 0.05, 0.2]]), np.array([40, 20, 10])
    for n in (1, 4, 8, 12, 16):
        got = pairs.tail(q, m, np.array([n, n]))
        for row, g in zip(q, got):
            pmf = np.array([1.0])
            for c, k in zip(row, m):
                for _ in range(k):
                    pmf = np.convolve(pmf, [1 - c, c])
            assert g == pytest.approx(np.log10(pmf[n:].sum()), abs=0.08)
