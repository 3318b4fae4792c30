import pytest

from corpusloom.operators import agreement as A


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a int, b int")


@pytest.mark.parametrize(("a", "b", "k"), [([1, 1, 0, 0], [1, 0, 0, 0], 0.5), ([1, 0, 1], [1, 0, 1], 1.0), ([1, 1], [0, 0], 0.0), ([1, 1], [1, 1], 1.0), ([1, None, 0], [1, 1, 0], 1.0)])
def test_cohen(spark, a, b, k):
    assert A.cohen(pairs(spark, a, b), "a", "b").first().kappa == pytest.approx(k)


def test_cohen_empty(spark):
    assert A.cohen(pairs(spark, [None], [1]), "a", "b").count() == 0


def test_fleiss(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1)], "i int, v int")
    assert A.fleiss(df, "i", "v").first().kappa == pytest.approx(-1 / 3)
    with pytest.raises(Exception, match="same number"):
        A.fleiss(spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "i int, v int"), "i", "v").collect()


def alpha(spark, rows, metric="nominal"):
    flat = [(u, v) for r in rows for u, v in enumerate(r) if v is not None]
    return A.alpha(spark.createDataFrame(flat, "u int, v int"), "u", "v", metric).first().alpha


def test_alpha(spark):
    assert alpha(spark, [[1, 1, 0, 0], [1, 0, 0, 0]]) == pytest.approx(0.5333, abs=1e-3)
    assert alpha(spark, [[1, 2, 3], [1, 2, 3]], "interval") == 1.0
    x = None
    rows = [[x, x, x, x, x, 3, 4, 1, 2, 1, 1, 3, 3, x, 3], [1, x, 2, 1, 3, 3, 4, 3, x, x, x, x, x, x, x], [x, x, 2, 1, 3, 4, 4, x, 2, 1, 1, 3, 3, x, 4]]
    assert alpha(spark, rows) == pytest.approx(0.691, abs=2e-3)


def docs(spark):
    return spark.createDataFrame([(1, "0123456789")], "id long, body string")


def segments(spark, rows):
    return spark.createDataFrame(rows, "id long, document_id long, code_id long, coder_id long, char_start int, char_end int")


def test_training(spark):
    s = segments(spark, [(1, 1, 5, 1, 0, 6), (2, 1, 5, 2, 2, 8)])
    r = A.training(A.document_units(docs(spark), "character"), s, 1, 2).first()
    assert (r.fn, r.fp, r.tp, r.tn) == (2, 2, 4, 2)


def test_units_and_pairs(spark):
    s = segments(spark, [(1, 1, 5, 1, 0, 6), (2, 1, 5, 2, 2, 8), (3, 1, 6, 3, 9, 99)])
    u = A.document_units(docs(spark), "segment", s)
    assert sorted((r.us, r.ue) for r in u.collect()) == [(0, 2), (2, 6), (6, 8), (8, 9), (9, 10)]
    k = {(r.code_id, r.coder_a, r.coder_b): r.kappa for r in A.pairwise_kappa(A.document_units(docs(spark), "character"), s).collect()}
    assert k[5, 1, 2] == pytest.approx((0.6 - 0.52) / 0.48) and (5, 1, 3) in k
    d = A.disagreements(u, s, docs(spark))
    assert {(r.code_id, r.us, r.coders) for r in d.collect()} == {(5, 0, "1"), (5, 2, "1,2"), (5, 6, "2"), (6, 9, "3")}
    g = {r.code_id: r for r in A.group_agreement(u, s).collect()}
    assert g[5].n_coders == 3 and g[5].n_units == 5 and g[5].fleiss < 0.3
    with pytest.raises(ValueError):
        A.document_units(docs(spark), "word")
