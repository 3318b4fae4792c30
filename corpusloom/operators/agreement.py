"""Inter-coder agreement as set operations.

Labels are kept sparse: only units a coder did code are rows, and zeros come from totals, so a character or
sentence grid over a whole corpus never has to be filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

GRANULARITIES = ("character", "sentence", "segment")


def kappa_of(n: Column, n11: Column, n1: Column, n2: Column) -> Column:
    """Cohen's kappa of two 0/1 raters from the totals: units, both 1, first 1, second 1.

    Null without units; 1 where chance agreement is complete.
    """
    po = (n - n1 - n2 + 2 * n11) / n
    pe = (n1 * n2 + (n - n1) * (n - n2)) / (n * n)
    return F.when(n == 0, F.lit(None).cast("double")).when(pe >= 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))


def cohen(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of columns a and b per group: by..., n, po, pe, kappa.

    Rows with a null drop out; without rows kappa is null; with complete chance agreement it is 1.
    """
    if not by:
        return cohen(pairs.withColumn("_all", F.lit(0)), a, b, ["_all"]).drop("_all")
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    conf = p.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    ra = conf.groupBy(*by, F.col("_a").alias("v")).agg(F.sum("c").alias("na"))
    rb = conf.groupBy(*by, F.col("_b").alias("v")).agg(F.sum("c").alias("nb"))
    chance = ra.join(rb, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    seen = conf.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0)).alias("o"))
    out = seen.join(chance, by, "left")
    po, pe = F.col("o") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    out = out.where(F.col("n") > 0).withColumns({"po": po, "pe": pe})
    return out.select(*by, "n", "po", "pe", F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa of (item, label) rows: n_items, raters, kappa.

    Null labels drop out. All items must have the same number of labels, at least two; otherwise the query
    fails when it runs. With complete chance agreement kappa is 1.
    """
    c = labels.where(F.col(label).isNotNull() & F.col(item).isNotNull()).groupBy(item, F.col(label).alias("v")).agg(F.count("*").alias("c"))
    each = c.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
    tot = each.groupBy(F.lit(0).alias("_all")).agg(F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg((F.col("q") - F.col("m")) / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0))).alias("p"))
    share = c.groupBy("v").agg(F.sum("c").alias("s"))
    pe = share.groupBy(F.lit(0).alias("_all")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("t"))
    bad = F.when((F.col("lo") != F.col("hi")) | (F.col("lo") < 2), F.raise_error(F.lit("items need the same number of labels, two or more")).cast("double"))
    out = tot.join(pe, "_all").where("n > 0").withColumn("pe", F.col("ss") / (F.col("t") * F.col("t")))
    return out.select(F.col("n").alias("n_items"), F.col("lo").alias("raters"), F.coalesce(bad, F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe")))).alias("kappa"))


def alpha(labels: DataFrame, unit: str, value: str, metric: str = "nominal", by: list[str] | None = None) -> DataFrame:
    """Krippendorff's alpha of (unit, value) rows, missing ones simply absent: by..., n, do, de, alpha.

    Units with one value are left out. Without pairs there is no row; with no expected disagreement alpha is 1
    if nothing was observed either, else 0. ``metric`` is nominal or interval.
    """
    if not by:
        return alpha(labels.withColumn("_all", F.lit(0)), unit, value, metric, ["_all"]).drop("_all")
    delta = {"nominal": lambda v, w: F.when(v == w, 0.0).otherwise(1.0), "interval": lambda v, w: (v - w) * (v - w)}[metric]
    n = labels.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(*by, unit, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    m = n.groupBy(*by, unit).agg(F.sum("c").alias("m")).where("m > 1")
    n = n.join(m, [*by, unit])
    w = n.select(*by, unit, F.col("v").alias("w"), F.col("c").alias("cw"))
    pairs = n.join(w, [*by, unit]).withColumn("o", F.col("c") * (F.col("cw") - F.when(F.col("v") == F.col("w"), 1).otherwise(0)) / (F.col("m") - 1))
    do = pairs.groupBy(*by).agg(F.sum(F.col("o") * delta(F.col("v"), F.col("w"))).alias("do"))
    margin = n.groupBy(*by, "v").agg(F.sum("c").alias("nv"))
    other = margin.select(*by, F.col("v").alias("w"), F.col("nv").alias("nw"))
    both = margin.join(other, by)
    de = both.groupBy(*by).agg(F.sum(F.col("nv") * F.col("nw") * delta(F.col("v"), F.col("w"))).alias("e"))
    total = margin.groupBy(*by).agg(F.sum("nv").alias("n"))
    out = do.join(de, by).join(total, by).where("n > 1")
    out = out.withColumns({"do": F.col("do") / F.col("n"), "de": F.col("e") / (F.col("n") * (F.col("n") - 1))})
    return out.select(*by, "n", "do", "de", F.when(F.col("de") == 0, F.when(F.col("do") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("do") / F.nullif(F.col("de"), F.lit(0.0))).alias("alpha"))


def document_units(documents: DataFrame, granularity: str, segments: DataFrame | None = None) -> DataFrame:
    """Units of every document: document_id, us, ue. An unknown granularity is an error.

    "segment" cuts a document at all boundaries of all its segments, whatever their code.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity: {granularity}")
    d = documents.select(F.col("id").alias("document_id"), "body")
    if granularity == "segment":
        bounds = segments.select(F.col("document_id").alias("_d"), F.explode(F.array("char_start", "char_end")).alias("b")).distinct()
        bounds = bounds.groupBy("_d").agg(F.collect_list("b").alias("bounds"))
        d = d.join(bounds, F.col("document_id") == F.col("_d"), "left")
        spans = T.atomic_spans(F.coalesce("bounds", F.expr("cast(array() as array<int>)")), F.length(F.coalesce("body", F.lit(""))))
    else:
        spans = T.sentence_spans(F.col("body")) if granularity == "sentence" else T.char_spans(F.col("body"))
    return d.select("document_id", F.explode(spans).alias("u")).select("document_id", F.col("u.char_start").alias("us"), F.col("u.char_end").alias("ue"))


#: Characters per bucket of the join of units with segments.
BUCKET = 256


def coded_units(units: DataFrame, segments: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Distinct (document_id, us, ue, coder_id, code_id) of units that one segment covers enough of.

    The share counts for each segment alone, not for their union. Joined on document and position bucket.
    """
    b = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.col(z) - 1) / BUCKET)))
    u = units.where("ue > us").withColumn("ub", b("us", "ue"))
    s = segments.where("char_end > char_start and char_start >= 0").select(F.col("document_id").alias("_d"), "coder_id", "code_id", "char_start", "char_end").distinct().withColumn("sb", b("char_start", "char_end"))
    share = F.least("ue", "char_end") - F.greatest("us", "char_start")
    met = u.join(s, (F.col("document_id") == F.col("_d")) & (F.col("ub") == F.col("sb")) & (share > 0))
    if min_ratio > 0:
        met = met.where(share / (F.col("ue") - F.col("us")) >= min_ratio)
    return met.select("document_id", "us", "ue", "coder_id", "code_id").distinct()


def pairwise_kappa(units: DataFrame, segments: DataFrame) -> DataFrame:
    """Cohen's kappa of every two coders of a document on every code that either used there.

    document_id, code_id, coder_a, coder_b, n, n11, n1, n2, kappa (coder_a < coder_b).
    """
    n = units.groupBy("document_id").agg(F.count("*").alias("n"))
    lab = coded_units(units, segments)
    one = lab.groupBy("document_id", "code_id", "coder_id").agg(F.count("*").alias("k"))
    coders = segments.select(F.col("document_id").alias("d"), F.col("coder_id").alias("c")).where("c is not null").distinct()
    other = coders.select(F.col("d").alias("d2"), F.col("c").alias("c2"))
    pairs = coders.join(other, (F.col("d") == F.col("d2")) & (F.col("c") < F.col("c2"))).select("d", F.col("c").alias("coder_a"), F.col("c2").alias("coder_b"))
    # a pair is looked at for the codes of its first and of its second coder
    either = one.select(F.col("document_id").alias("d1"), "code_id", "coder_id")
    cases = pairs.join(either, (F.col("d") == F.col("d1")) & ((F.col("coder_id") == F.col("coder_a")) | (F.col("coder_id") == F.col("coder_b")))).select("d", "code_id", "coder_a", "coder_b").distinct()
    l2 = lab.select(F.col("document_id").alias("d2"), F.col("us").alias("us2"), F.col("code_id").alias("k2"), F.col("coder_id").alias("coder_2"))
    both = lab.join(l2, (F.col("document_id") == F.col("d2")) & (F.col("us") == F.col("us2")) & (F.col("code_id") == F.col("k2")) & (F.col("coder_id") < F.col("coder_2")))
    both = both.groupBy(F.col("document_id").alias("bd"), F.col("code_id").alias("bk"), F.col("coder_id").alias("ba"), F.col("coder_2").alias("bb")).agg(F.count("*").alias("n11"))
    a = one.select(F.col("document_id").alias("ad"), F.col("code_id").alias("ak"), F.col("coder_id").alias("aa"), F.col("k").alias("n1"))
    z = one.select(F.col("document_id").alias("zd"), F.col("code_id").alias("zk"), F.col("coder_id").alias("zz"), F.col("k").alias("n2"))
    out = (
        cases.join(n, F.col("d") == F.col("document_id"))
        .join(both, (F.col("d") == F.col("bd")) & (F.col("code_id") == F.col("bk")) & (F.col("coder_a") == F.col("ba")) & (F.col("coder_b") == F.col("bb")), "left")
        .join(a, (F.col("d") == F.col("ad")) & (F.col("code_id") == F.col("ak")) & (F.col("coder_a") == F.col("aa")), "left")
        .join(z, (F.col("d") == F.col("zd")) & (F.col("code_id") == F.col("zk")) & (F.col("coder_b") == F.col("zz")), "left")
    )
    out = out.select("document_id", "code_id", "coder_a", "coder_b", "n", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n11", "n1", "n2")])
    return out.withColumn("kappa", kappa_of(*(F.col(x).cast("double") for x in ("n", "n11", "n1", "n2"))))


def group_agreement(units: DataFrame, segments: DataFrame) -> DataFrame:
    """Fleiss' kappa and nominal alpha of all coders of a document on each code used there.

    document_id, code_id, n_units, n_coders, fleiss, alpha, for documents with two coders or more.
    """
    n = units.groupBy(F.col("document_id").alias("nd")).agg(F.count("*").cast("double").alias("n"))
    m = segments.where("coder_id is not null").groupBy(F.col("document_id").alias("md")).agg(F.countDistinct("coder_id").cast("double").alias("m")).where("m >= 2")
    c = coded_units(units, segments.where("coder_id is not null")).groupBy("document_id", "code_id", "us").agg(F.count("*").cast("double").alias("c"))
    s = c.groupBy("document_id", "code_id").agg(F.sum("c").alias("ones"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count("*").cast("double").alias("k"))
    s = s.join(n, F.col("document_id") == F.col("nd")).join(m, F.col("document_id") == F.col("md"))
    ones, N = F.col("ones"), F.col("n") * F.col("m")
    # a unit with c ones has c(m-c) unequal pairs; units nobody coded have none
    unequal = F.col("m") * ones - F.col("sq")
    p = 1 - 2 * unequal / (F.col("n") * F.col("m") * (F.col("m") - 1))
    p1 = ones / N
    pe = p1 * p1 + (1 - p1) * (1 - p1)
    do = 2 * unequal / (F.col("m") - 1) / N
    de = 2 * ones * (N - ones) / (N * (N - 1))
    return s.select(
        "document_id", "code_id", F.col("n").cast("long").alias("n_units"), F.col("m").cast("long").alias("n_coders"),
        F.when(pe >= 1, 1.0).otherwise((p - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("fleiss"),
        F.when(de == 0, F.when(do == 0, 1.0).otherwise(0.0)).otherwise(1 - do / F.nullif(de, F.lit(0.0))).alias("alpha"),
    )


def disagreements(units: DataFrame, segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Units some but not all coders of a document gave a code: document_id, code_id, us, ue, text, coders, n_coders."""
    m = segments.where("coder_id is not null").groupBy(F.col("document_id").alias("md")).agg(F.countDistinct("coder_id").alias("n_coders")).where("n_coders >= 2")
    c = coded_units(units, segments.where("coder_id is not null")).groupBy("document_id", "code_id", "us", "ue").agg(F.sort_array(F.collect_list("coder_id")).alias("coders"))
    d = documents.select(F.col("id").alias("_d"), "body")
    out = c.join(m, F.col("document_id") == F.col("md")).where(F.size("coders") < F.col("n_coders"))
    return out.join(d, F.col("document_id") == F.col("_d")).select("document_id", "code_id", "us", "ue", F.expr("substring(body, us + 1, ue - us)").alias("text"), F.array_join("coders", ",").alias("coders"), "n_coders")


def disagreement_table(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """Disagreements with a 0/1 column for each named coder."""
    out = rows.withColumn("_c", F.split("coders", ","))
    return out.select("document_id", "code_id", "us", "ue", "text", *[F.array_contains("_c", str(k)).cast("int").alias(v) for k, v in sorted(names.items())])


def training(units: DataFrame, segments: DataFrame, master: int, trainee: int) -> DataFrame:
    """Per document and code: tp, fp, fn, tn of a trainee against a master, and their kappa."""
    s = segments.where(F.col("coder_id").isin(master, trainee))
    lab = coded_units(units, s).groupBy("document_id", "code_id", "us").agg(F.max((F.col("coder_id") == master).cast("int")).alias("m"), F.max((F.col("coder_id") == trainee).cast("int")).alias("t"))
    n = units.groupBy(F.col("document_id").alias("nd")).agg(F.count("*").alias("n"))
    both = F.sum(F.col("m") * F.col("t"))
    k = lab.groupBy("document_id", "code_id").agg(both.alias("tp"), F.sum((1 - F.col("m")) * F.col("t")).alias("fp"), F.sum(F.col("m") * (1 - F.col("t"))).alias("fn"))
    out = k.join(n, F.col("document_id") == F.col("nd")).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    d = lambda c: c.cast("double")
    return out.select("document_id", "code_id", "tp", "fp", "fn", "tn", kappa_of(d(F.col("n")), d(F.col("tp")), d(F.col("tp") + F.col("fn")), d(F.col("tp") + F.col("fp"))).alias("kappa"))


def training_lists(units: DataFrame, segments: DataFrame, documents: DataFrame, master: int, trainee: int) -> DataFrame:
    """Units that only one of the two gave a code: document_id, code_id, us, ue, text and kind, missed or extra."""
    s = segments.where(F.col("coder_id").isin(master, trainee))
    one = coded_units(units, s).groupBy("document_id", "code_id", "us", "ue").agg(F.collect_set("coder_id").alias("who")).where(F.size("who") == 1)
    d = documents.select(F.col("id").alias("_d"), "body")
    kind = F.when(F.col("who")[0] == master, "missed").otherwise("extra")
    return one.join(d, F.col("document_id") == F.col("_d")).select("document_id", "code_id", "us", "ue", F.expr("substring(body, us + 1, ue - us)").alias("text"), kind.alias("kind"))


def latest_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
