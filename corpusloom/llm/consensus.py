"""Consensus from several annotators' labels.

Competence-and-spamming mixture: annotator j's label of a unit is the unit's true code with probability
``theta[j]``, and otherwise a draw from j's personal guess distribution ``xi[j]``. Expectation-maximisation
yields both and the posterior of each unit's code. For a label l the evidence it adds to "the true code is l"
is ``log(1 + theta / ((1 - theta) * xi(l)))``; everything else cancels, so a round is one join of the labels
with the current (annotator, code) parameters, one window over a unit's labels and one aggregation. All are
Spark SQL operators over all labels; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, lookup

#: Characters per bucket of the span join.
SPAN_BUCKET = 256


def span_labels(segments: DataFrame, units: DataFrame) -> DataFrame:
    """Labels (unit_id, document_id, coder_id, code_id) given by the segments that overlap a unit.

    Equi-join on document and position bucket, then the overlap test, so even a document that holds a third
    of all rows is spread over its buckets. A segment that overlaps several units belongs to the one it
    overlaps most (ties: the smallest unit_id). Rows with a null key or an empty span are ignored; repeated
    rows count once.
    """
    b = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / SPAN_BUCKET), F.floor((F.col(z) - 1) / SPAN_BUCKET)))
    u = (
        units.select("unit_id", F.col("document_id").alias("u_doc"), F.col("char_start").alias("us"), F.col("char_end").alias("ue"))
        .where("unit_id is not null and u_doc is not null and ue > us and us >= 0")
        .distinct()
        .withColumn("u_b", b("us", "ue"))
    )
    s = (
        segments.select("id", "document_id", "coder_id", "code_id", "char_start", "char_end")
        .where("document_id is not null and coder_id is not null and code_id is not null and char_end > char_start and char_start >= 0")
        .distinct()
        .withColumn("s_b", b("char_start", "char_end"))
    )
    met = s.join(u, (F.col("document_id") == F.col("u_doc")) & (F.col("s_b") == F.col("u_b")) & (F.col("char_start") < F.col("ue")) & (F.col("us") < F.col("char_end")))
    share = (F.least("char_end", "ue") - F.greatest("char_start", "us")).cast("long")
    best = met.groupBy("document_id", "coder_id", "code_id", "char_start", "char_end").agg(F.max(F.struct(share.alias("n"), (-F.col("unit_id")).alias("k"))).alias("m"))
    return best.select((-F.col("m.k")).alias("unit_id"), "document_id", "coder_id", "code_id").distinct()


def fit_competence(labels: DataFrame, *, space: str = "space", tolerance: float = 2e-3, most: int = 200, theta0: float = 0.7, smooth: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Posterior codes and annotator competence.

    ``labels``: unit_id, coder_id, code_id and ``space``, the label set a unit chooses from (for codes: the
    project). Returns ``(posterior, coders)``: posterior has unit_id, code_id, posterior (of each code that
    someone gave the unit); coders has coder_id, competence, n_labels. Repeated labels count once; labels with
    a null in any column are ignored; without labels both results are empty. Competence has a Beta(7, 3)/5
    prior, guess distributions a symmetric one of weight ``smooth``, so single-label annotators stay defined.

    Rounds go on until no annotator's competence moves by more than ``tolerance``; a fit that has not settled
    after ``most`` rounds is an error.
    """
    lab = labels.select("unit_id", "coder_id", "code_id", F.col(space).alias("space")).dropna().distinct()
    sizes = lab.select("space", "code_id").distinct().groupBy("space").agg(F.count("*").alias("k"))
    lab = cut(lookup(cut(lab), "space", sizes.select(F.col("space").alias("_s"), "k"), "_s").drop("_s"))

    given = lab.groupBy("coder_id", "space", "code_id").agg(F.first("k").alias("k"), F.count("*").alias("n"))
    own = Window.partitionBy("coder_id", "space")
    # before the first round the guesses of an annotator follow the labels given
    params = given.select("coder_id", "code_id", F.lit(theta0).alias("theta"), ((F.col("n") + smooth / F.col("k")) / (F.sum("n").over(own) + smooth)).alias("xi"))
    unit, vote = Window.partitionBy("unit_id"), Window.partitionBy("unit_id", "code_id")
    for _ in range(most):
        params = cut(params)
        odds = F.col("theta") / ((1 - F.col("theta")) * F.col("xi"))
        scored = (
            lab.join(params, ["coder_id", "code_id"])
            .withColumn("odds", odds)
            .withColumn("score", F.sum(F.log1p("odds")).over(vote))
            .withColumn("top", F.max("score").over(unit))
            .withColumn("votes", F.count("*").over(vote))
        )
        mass = F.exp(F.col("score") - F.col("top"))
        total = F.sum(mass / F.col("votes")).over(unit) + (F.col("k") - F.sum(1 / F.col("votes")).over(unit)) * F.exp(-F.col("top"))
        scored = scored.withColumn("posterior", mass / total)
        truthful = F.col("posterior") * F.col("odds") / (1 + F.col("odds"))
        step = scored.groupBy("coder_id", "space", "code_id").agg(F.first("k").alias("k"), F.count("*").alias("n"), F.sum(truthful).alias("s"), F.first("theta").alias("was"))
        step = cut(step)
        # one row a coder; Spark broadcasts it while its size allows
        total = step.groupBy(F.col("coder_id").alias("_c")).agg(((F.sum("s") + 1.4) / (F.sum("n") + 2.0)).alias("theta"), F.first("was").alias("was"))
        moved = total.agg(F.max(F.abs(F.col("theta") - F.col("was")))).first()[0]
        if moved is None or moved < tolerance:
            break
        params = step.join(total, F.col("coder_id") == F.col("_c")).select(
            "coder_id",
            "code_id",
            "theta",
            ((F.col("n") - F.col("s") + smooth / F.col("k")) / (F.sum(F.col("n") - F.col("s")).over(own) + smooth)).alias("xi"),
        )
    else:
        raise RuntimeError(f"competences still move by {moved:.4f} after {most} rounds")
    posterior = scored.groupBy("unit_id", "code_id").agg(F.first("posterior").alias("posterior"))
    coders = scored.groupBy("coder_id").agg(F.first("theta").alias("competence"), F.count("*").alias("n_labels"))
    return posterior, coders


def consensus(labels: DataFrame, posterior: DataFrame, *, min_coders: int = 1) -> DataFrame:
    """One code per unit: unit_id, code_id, confidence, n_coders, agreement.

    ``agreement`` is the share of agreeing pairs among the unit's labels (null for a single label). Equal
    posteriors go to the smaller code. Units with fewer than ``min_coders`` different coders are left out.
    """
    lab = labels.select("unit_id", "coder_id", "code_id").dropna().distinct()
    votes = lab.groupBy("unit_id", "code_id").agg(F.count("*").alias("v"))
    n = F.sum("v")
    agree = votes.groupBy("unit_id").agg(F.when(n > 1, F.sum(F.col("v") * (F.col("v") - 1)) / (n * (n - 1))).alias("agreement"))
    coders = lab.groupBy("unit_id").agg(F.countDistinct("coder_id").alias("n_coders")).where(F.col("n_coders") >= min_coders)
    best = posterior.groupBy("unit_id").agg(F.max(F.struct(F.round("posterior", 9).alias("p"), (-F.col("code_id")).alias("c"))).alias("b"))
    return best.join(coders, "unit_id").join(agree, "unit_id").select("unit_id", (-F.col("b.c")).alias("code_id"), F.col("b.p").alias("confidence"), "n_coders", "agreement")
