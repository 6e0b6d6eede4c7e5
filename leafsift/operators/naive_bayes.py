"""Multinomial naive Bayes as tables.

A model is a table ``term, f0, f1`` (summed weights per class) and one row of
totals per model. Training is one aggregation by term, scoring one join by
term. Of the vocabulary only a fixed number of frequent terms passes through
the driver, of the passages nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import explode_rows, shuffled_join
from leafsift.operators.features import known_counts, term_counts, term_weights
from leafsift.session import materialise

# Copies of a vocabulary row when folds are scored, so that a frequent term is spread over tasks.
TERM_SALTS = 8
# The most frequent terms of a model, which every task holds when passages are scored.
HELD_TERMS = 1 << 15


def _class_sum(label: int) -> Column:
    return F.sum(F.when(F.col("class") == label, F.col("w")).otherwise(0.0))


def train(labelled: DataFrame, alpha: float = 1.0, ngram_range: tuple[int, int] = (1, 1)) -> tuple[DataFrame, DataFrame]:
    """Model of ``text, class`` rows: vocabulary ``term, f0, f1, theta0, theta1`` and one row of totals.

    theta is the smoothed log probability of a term in a class; totals hold
    the class priors, weight sums and the vocabulary size.
    """
    weights = term_weights(term_counts(labelled.select("class", "text"), ngram_range=ngram_range))
    terms = materialise(weights.groupBy("term").agg(_class_sum(0).alias("f0"), _class_sum(1).alias("f1")))
    sums = terms.agg(F.sum("f0").alias("s0"), F.sum("f1").alias("s1"), F.count(F.lit(1)).alias("v"))
    rows = labelled.agg(F.count_if(F.col("class") == 0).alias("n0"), F.count_if(F.col("class") == 1).alias("n1"))
    totals = (
        sums.withColumn("_one", F.lit(1))
        .join(F.broadcast(rows.withColumn("_one", F.lit(1))), "_one")
        .select(
            "s0", "s1", "v", "n0", "n1",
            F.lit(float(alpha)).alias("alpha"),
            F.log(F.col("n0") / (F.col("n0") + F.col("n1"))).alias("prior0"),
            F.log(F.col("n1") / (F.col("n0") + F.col("n1"))).alias("prior1"),
            F.lit(ngram_range[0]).alias("ngram_low"),
            F.lit(ngram_range[1]).alias("ngram_high"),
        )
    )
    # Totals are one row.
    joined = terms.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")
    vocabulary = joined.select("term", "f0", "f1", theta("0").alias("theta0"), theta("1").alias("theta1"))
    return vocabulary, totals


def theta(label: str) -> Column:
    """Log probability of a term from its class weight and the totals."""
    return F.log(F.col("f" + label) + F.col("alpha")) - F.log(
        F.col("s" + label) + F.col("alpha") * F.col("v").cast("double")
    )


def posterior(score0: Column, score1: Column) -> Column:
    """Probability of class 1 from two log scores."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(score0 - score1))


def score(
    passages: DataFrame,
    ident: Sequence[str],
    vocabulary: DataFrame,
    totals: DataFrame,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Add ``likelihood`` and ``predicted_class`` to passages with unique ``ident`` columns.

    Weights are normalised over known terms only; a passage without any gets
    the prior. The most frequent terms of the model, so many at most, are summed
    where a passage is read; only occurrences of the others are shuffled and
    joined by term. The counts are written once, as both parts need them.
    """
    ident = list(ident)
    frequent = vocabulary.select("term", "theta0", "theta1").orderBy(F.greatest("theta0", "theta1").desc(), "term").limit(HELD_TERMS)
    # One row made by a task: collected as rows, the most frequent terms of every partition would meet in the driver.
    gathered = frequent.agg(F.collect_list(F.struct("term", "theta0", "theta1")).alias("terms")).collect()[0]["terms"]
    held = {r["term"]: (r["theta0"], r["theta1"]) for r in gathered}
    counted = materialise(known_counts(passages.select(*ident, "text"), held, ngram_range).select(*ident, "counted.*"))
    n = F.col("_t.n").cast("double")
    rest = explode_rows(counted.select(*ident, "rest"), F.col("rest"), "_t").select(*ident, F.col("_t.term").alias("term"), n.alias("n"))
    joined = shuffled_join(rest, vocabulary.select("term", "theta0", "theta1"), ["term"]).select(
        *ident, (F.col("n") * F.col("theta0")).alias("t0"), (F.col("n") * F.col("theta1")).alias("t1"), (F.col("n") * F.col("n")).alias("squares"))
    sums = joined.unionByName(counted.drop("rest")).groupBy(*ident).agg(
        F.sum("t0").alias("_t0"), F.sum("t1").alias("_t1"), F.sum("squares").alias("_squares"))
    # A passage without a known term has no length, and the prior alone.
    sums = sums.filter("_squares > 0").withColumn("_len", F.sqrt("_squares")).drop("_squares")
    # Totals are one row.
    priors = F.broadcast(totals.select("prior0", "prior1", F.lit(1).alias("_one")))
    joined = shuffled_join(passages, sums, ident, "left").withColumn("_one", F.lit(1)).join(priors, "_one")
    s0 = F.col("prior0") + F.coalesce(F.col("_t0") / F.col("_len"), F.lit(0.0))
    s1 = F.col("prior1") + F.coalesce(F.col("_t1") / F.col("_len"), F.lit(0.0))
    scored = joined.withColumn("likelihood", posterior(s0, s1))
    scored = scored.withColumn("predicted_class", F.when(F.col("likelihood") > 0.5, 1).otherwise(0))
    return scored.drop("_one", "_t0", "_t1", "_len", "prior0", "prior1")


def cross_validate(
    folded: DataFrame,
    ident: str,
    alphas: Sequence[float] = (1.0,),
    ngram_range: tuple[int, int] = (1, 1),
    k: int = 10,
) -> DataFrame:
    """Out-of-fold predictions for all folds and smoothing values in one job.

    Input ``ident, text, class, fold``; output one row per passage and alpha
    with ``likelihood`` and ``prediction``. A term row carries its weight per
    fold and class, so the k training sets need one aggregation, not k.
    """
    counted = materialise(term_counts(folded.select(ident, "class", "fold", "text"), ngram_range=ngram_range).drop("text"))
    weights = term_weights(counted)
    sums = [
        F.sum(F.when((F.col("fold") == f) & (F.col("class") == c), F.col("w")).otherwise(0.0)).alias(f"_{c}_{f}")
        for f in range(k)
        for c in (0, 1)
    ]
    seen = [F.count_if(F.col("fold") == f).alias(f"_n_{f}") for f in range(k)]
    per_term = weights.groupBy("term").agg(*sums, *seen)

    def others(prefix: str, fold: int) -> Column:
        total = F.lit(0)
        for f in range(k):
            total = total + F.col(f"{prefix}{f}") if f != fold else total
        return total

    # One row per term: what each training set knows of it, by fold.
    known = materialise(per_term.select(
        "term",
        F.array(*[others("_n_", f) for f in range(k)]).alias("_seen"),
        *[F.array(*[others(f"_{c}_", f).cast("double") for f in range(k)]).alias(f"_f{c}") for c in (0, 1)],
    ))
    sums = known.agg(*[
        F.sum(F.when(F.get("_seen", F.lit(f)) > 0, value).otherwise(0)).alias(f"_{name}_{f}")
        for f in range(k)
        for name, value in (("s0", F.get("_f0", F.lit(f))), ("s1", F.get("_f1", F.lit(f))), ("v", F.lit(1)))
    ])
    sizes = sums.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("fold"), *[F.col(f"_{name}_{f}").alias(name) for name in ("s0", "s1", "v")]) for f in range(k)
    ])).alias("_z")).select("_z.*")

    rows = counted.groupBy("fold").agg(F.count_if(F.col("class") == 0).alias("n0"), F.count_if(F.col("class") == 1).alias("n1"))
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left_in = (
        rows.withColumnRenamed("fold", "_own").withColumn("fold", folds).filter(F.col("_own") != F.col("fold"))
        .groupBy("fold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .select(
            "fold",
            F.log(F.col("n0") / (F.col("n0") + F.col("n1"))).alias("prior0"),
            F.log(F.col("n1") / (F.col("n0") + F.col("n1"))).alias("prior1"),
        )
    )
    # At most k rows.
    setting = F.broadcast(sizes.join(left_in, "fold"))

    occurrences = explode_rows(counted, F.col("terms"), "_t").select(
        ident, "fold", F.pmod(F.hash(ident), F.lit(TERM_SALTS)).alias("_salt"),
        F.col("_t.term").alias("term"), F.col("_t.n").cast("double").alias("n"),
    )
    salts_of = F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
    own = F.col("fold")
    hits = (
        shuffled_join(occurrences, known.withColumn("_salt", salts_of), ["term", "_salt"])
        .filter(F.get("_seen", own) > 0)
        .withColumns({"f0": F.get("_f0", own), "f1": F.get("_f1", own)})
        .join(setting.select("fold", "s0", "s1", "v"), "fold")
    )
    score_sums = []
    for i, alpha in enumerate(alphas):
        for c in ("0", "1"):
            th = F.log(F.col("f" + c) + F.lit(float(alpha))) - F.log(F.col("s" + c) + F.lit(float(alpha)) * F.col("v").cast("double"))
            score_sums.append(F.sum(F.col("n") * th).alias(f"_s{c}_{i}"))
    per_doc = hits.groupBy(ident).agg(*score_sums, F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_len"))
    joined = counted.select(ident, "class", "fold").join(per_doc, ident, "left").join(
        setting.select("fold", "prior0", "prior1"), "fold"
    )

    def likelihood(i: int) -> Column:
        s = [
            F.col(f"prior{c}") + F.coalesce(F.col(f"_s{c}_{i}") / F.col("_len"), F.lit(0.0)) for c in ("0", "1")
        ]
        return posterior(*s)

    results = F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), likelihood(i).alias("likelihood")) for i, a in enumerate(alphas)
    ])
    return joined.withColumn("_r", F.explode_outer(results)).select(
        ident, "class", "fold", "_r.alpha", "_r.likelihood",
        F.when(F.col("_r.likelihood") > 0.5, 1).otherwise(0).alias("prediction"),
    )


def top_terms(vocabulary: DataFrame, n: int = 10, weight: str = "theta1") -> DataFrame:
    """The ``n`` lowest and ``n`` highest weights with their terms: ``side, weight, term``."""
    w = vocabulary.select(F.col(weight).alias("weight"), "term")
    low = w.orderBy("weight", "term").limit(n).withColumn("side", F.lit("lowest"))
    high = w.orderBy(F.desc("weight"), F.desc("term")).limit(n).withColumn("side", F.lit("highest"))
    return low.unionByName(high)
