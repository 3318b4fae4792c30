"""Items that appear together: exact pair counts against a bipartite configuration null.

Counts are exact. The null honours both margins: in a project, item i is in basket d with probability
``x_i*y_d / (1 + x_i*y_d)``, where x and y are fitted so that every item keeps its number of baskets and every
basket its number of items. Items with the same count share an x and baskets of the same size a y, so a
project is fitted on its degree classes. The count of a pair is then Poisson-binomial; its upper tail is taken
by a saddle-point expansion, and Benjamini-Hochberg over all pairs turns tails into q-values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, lookup, spread

#: Items of a basket that are paired in one row; larger baskets are paired block by block.
BLOCK = 64
#: Width of a class of -log10 p for false-discovery control, and the largest value told apart.
BIN, BIN_MAX = 0.01, 300.0
#: Distinct triples of counts that one task takes.
TRIPLES = 200_000


def baskets(rows: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """Distinct (g, basket, item) without nulls; repeated rows count once."""
    return rows.select(F.col(group).alias("g"), F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()


def pair_counts(b: DataFrame) -> DataFrame:
    """Exact (g, a, b, n_ab) for a < b over distinct baskets.

    A basket of more than ``BLOCK`` items is cut into blocks by a hash of the item, and each pair of its blocks is
    a row with a key of its own, so a basket with a third of all rows is spread over many tasks; no window or
    group holds a whole one. Counts are combined before the shuffle.
    """
    keyed = b.withColumn("bk", F.to_json(F.struct("g", "basket")))
    large = keyed.groupBy(F.col("bk").alias("_bk")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("nb > 1")
    keyed = lookup(cut(keyed), "bk", cut(large), "_bk").withColumn("nb", F.coalesce("nb", F.lit(1)))
    numbered = keyed.withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    blocks = numbered.groupBy("g", "basket", "blk").agg(F.sort_array(F.collect_list("item")).alias("items"), F.first("nb").alias("nb"))
    within = blocks.select("g", F.expr("inline(flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(x as a, y as b)))))"))
    sent = blocks.where("nb > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("to <> blk")
    met = sent.groupBy("g", "basket", F.least("blk", "to").alias("lo"), F.greatest("blk", "to").alias("hi")).agg(F.collect_list("items").alias("two")).where(F.size("two") == 2)
    across = met.select("g", F.expr("inline(flatten(transform(two[0], x -> transform(two[1], y -> struct(least(x, y) as a, greatest(x, y) as b)))))"))
    return within.unionByName(across).groupBy("g", "a", "b").agg(F.count("*").alias("n_ab"))


def fit_classes(k: np.ndarray, mk: np.ndarray, d: np.ndarray, md: np.ndarray, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """x of the item classes (degree k, mk items each) and y of the basket classes (size d, md baskets each).

    Rounds go on until both margins hold to a millionth. An item in every basket, or a basket of every item, has
    no finite weight and gets a very large one; those close to it settle slowly and are left after ``most`` rounds, when
    their margins hold to about 1 in ``most``.
    """
    x = k / np.sqrt(max(1.0, float((k * mk).sum())))
    y = d / np.sqrt(max(1.0, float((k * mk).sum())))
    full_x, full_y = k >= md.sum(), d >= mk.sum()
    for _ in range(most):
        x = np.where(full_x, 1e9, np.minimum(k / np.maximum((md * y / (1 + x[:, None] * y)).sum(1), 1e-300), 1e9))
        y = np.where(full_y, 1e9, np.minimum(d / np.maximum((mk * x / (1 + y[:, None] * x)).sum(1), 1e-300), 1e9))
        p = x[:, None] * y
        p /= 1 + p
        if max(np.abs(p @ md / k - 1).max(initial=0), np.abs(mk @ p / d - 1).max(initial=0)) < 1e-6:
            break
    return x, y


def tail(q: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of P(sum >= n) for rows of success chances q with multiplicities m: Lugannani-Rice, lattice form."""
    mean = (q * m).sum(1)
    most = ((q > 0) * m).sum(1)
    n = n.astype(float)
    v = np.clip(n - 0.5, 1e-3, np.maximum(most - 1e-3, 2e-3))
    t = np.zeros(len(n))
    lo, hi = np.full(len(n), -60.0), np.full(len(n), 60.0)
    for _ in range(80):  # bisection with Newton steps on K'(t) = v
        e = q * np.exp(t)[:, None]
        p = e / (1 - q + e)
        k1, k2 = (m * p).sum(1), (m * p * (1 - p)).sum(1)
        lo, hi = np.where(k1 < v, t, lo), np.where(k1 < v, hi, t)
        new = t - (k1 - v) / np.maximum(k2, 1e-12)
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        if np.abs(new - t).max(initial=0) < 1e-10:
            t = new
            break
        t = new
    e = q * np.exp(t)[:, None]
    p = e / (1 - q + e)
    k0, k2 = (m * np.log(np.maximum(1 - q + e, 1e-300))).sum(1), np.maximum((m * p * (1 - p)).sum(1), 1e-12)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * v - k0), 0))
    u = 2 * np.sinh(t / 2) * np.sqrt(k2)
    from math import erfc

    near = np.abs(t) < 1e-4
    with np.errstate(all="ignore"):
        gauss = np.array([0.5 * erfc(a / 1.4142135623730951) for a in w])
        far = w > 30
        dens = np.exp(-w * w / 2) / np.sqrt(2 * np.pi)
        pr = np.where(near, 0.5, gauss + dens * (1 / np.where(near, 1, u) - 1 / np.where(near, 1, w)))
        lg = np.log10(np.clip(pr, 1e-300, 1.0))
        lg = np.where(far, -w * w / 2 / np.log(10) - np.log10(np.sqrt(2 * np.pi) * np.maximum(u, 1e-12)), lg)
    lg = np.where(n <= 0, 0.0, np.where(n > most, -BIN_MAX, lg))
    return np.clip(lg, -BIN_MAX, 0.0) + 0 * mean


def _tails(key: tuple, classes: pd.DataFrame, triples: pd.DataFrame) -> pd.DataFrame:
    out = triples[["g", "k_a", "k_b", "n_ab"]].copy()
    it, ba = classes[classes.kind == "item"], classes[classes.kind == "basket"]
    k, mk, d, md = (s.to_numpy(float) for s in (it.degree, it.m, ba.degree, ba.m))
    if not len(out) or not len(k) or not len(d):
        return out.assign(expected=[], log10_p=[]) if not len(out) else out.assign(expected=np.nan, log10_p=0.0)
    x, y = fit_classes(k, mk, d, md)
    p = (x[:, None] * y) / (1 + x[:, None] * y)
    at = {int(v): i for i, v in enumerate(k)}
    ia, ib = out.k_a.map(at).to_numpy(), out.k_b.map(at).to_numpy()
    exp, lg = np.empty(len(out)), np.empty(len(out))
    for s in range(0, len(out), 4096):
        q = p[ia[s : s + 4096]] * p[ib[s : s + 4096]]
        exp[s : s + 4096] = (q * md).sum(1)
        lg[s : s + 4096] = tail(q, md, out.n_ab.to_numpy()[s : s + 4096])
    return out.assign(expected=exp, log10_p=lg)


def surprising_pairs(rows: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """All pairs of items of a group that share a basket, with how far they exceed chance.

    Returns g, a, b (a < b), n_ab, n_a, n_b, n (baskets of the group), lift = n_ab*n/(n_a*n_b), expected
    (under the null), log10_p (upper tail) and q_value (Benjamini-Hochberg over all pairs of all groups, in
    classes of p of ``BIN`` decades, rounded up). Rows with a null in group, basket or item are ignored,
    repeated rows count once, an empty table gives an empty result.
    """
    b = cut(baskets(rows, group, basket, item))
    n_item = b.groupBy("g", "item").agg(F.count("*").alias("k"))
    n_basket = b.groupBy("g", "basket").agg(F.count("*").alias("d"))
    n = n_basket.groupBy("g").agg(F.count("*").alias("n"))
    pairs = pair_counts(b)
    ka = n_item.select(F.col("g").alias("ga"), F.col("item").alias("ia"), F.col("k").alias("k_a"))
    kb = n_item.select(F.col("g").alias("gb"), F.col("item").alias("ib"), F.col("k").alias("k_b"))
    pairs = (
        pairs.join(ka, (F.col("g") == F.col("ga")) & (F.col("a") == F.col("ia")))
        .join(kb, (F.col("g") == F.col("gb")) & (F.col("b") == F.col("ib")))
        .select("g", "a", "b", "n_ab", "k_a", "k_b")
    )
    pairs = cut(pairs)
    classes = (
        n_item.groupBy("g", F.lit("item").alias("kind"), F.col("k").alias("degree")).agg(F.count("*").alias("m"))
        .unionByName(n_basket.groupBy("g", F.lit("basket").alias("kind"), F.col("d").alias("degree")).agg(F.count("*").alias("m")))
    )
    lo, hi = F.least("k_a", "k_b"), F.greatest("k_a", "k_b")
    # a group's distinct triples of counts: the tail depends on nothing else
    triples = pairs.select("g", lo.alias("k_a"), hi.alias("k_b"), "n_ab").distinct()
    # a group with very many triples is cut into parts, each with the group's (few) classes
    triples = cut(triples)
    parts = triples.groupBy(F.col("g").alias("pg")).agg(F.ceil(F.count("*") / TRIPLES).cast("int").alias("parts"))
    cutted = lookup(triples, "g", parts, "pg").withColumn("part", F.pmod(F.xxhash64("k_a", "k_b", "n_ab"), F.col("parts")).cast("int"))
    classes = classes.join(parts, F.col("g") == F.col("pg")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    classes = classes.select(F.col("g").alias("cg"), "kind", "degree", "m", "part")
    left, right = spread(cutted.drop("pg", "parts"), "g", "part").groupBy("g", "part"), spread(classes, "cg", "part").groupBy("cg", "part")
    tails = left.cogroup(right).applyInPandas(lambda key, t, c: _tails(key, c, t), "g long, k_a long, k_b long, n_ab long, expected double, log10_p double")
    tails = tails.select(F.col("g").alias("tg"), F.col("k_a").alias("t_a"), F.col("k_b").alias("t_b"), F.col("n_ab").alias("t_n"), "expected", "log10_p")
    on = (F.col("g") == F.col("tg")) & (lo == F.col("t_a")) & (hi == F.col("t_b")) & (F.col("n_ab") == F.col("t_n"))
    scored = cut(pairs.join(tails, on).withColumn("bin", F.floor(-F.col("log10_p") / BIN).cast("int")))
    # at most BIN_MAX / BIN classes, so the running sum and the broadcast below are bounded
    bins = scored.groupBy("bin").agg(F.count("*").alias("c"))
    down = Window.orderBy(F.col("bin").desc())
    total = F.sum("c").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    q = bins.withColumn("raw", F.pow(F.lit(10.0), -F.col("bin") * BIN) * total / F.sum("c").over(down)).withColumn(
        "q_value", F.least(F.lit(1.0), F.min("raw").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    )
    q = q.select(F.col("bin").alias("_bin"), "q_value")
    ng = n.select(F.col("g").alias("ng"), "n")
    return (
        scored.join(F.broadcast(q), F.col("bin") == F.col("_bin"))
        .join(ng, F.col("g") == F.col("ng"))
        .select(
            "g", "a", "b", "n_ab", F.col("k_a").alias("n_a"), F.col("k_b").alias("n_b"), "n",
            (F.col("n_ab") * F.col("n") / (F.col("k_a") * F.col("k_b"))).alias("lift"), "expected", "log10_p", "q_value",
        )
    )
