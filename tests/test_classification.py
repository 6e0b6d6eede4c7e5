import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from leafsift.functions.text import mask_numbers
from leafsift.operators import categories, evaluate, features, linear, naive_bayes, sampling
from leafsift.plans import assess, training
from pyspark.sql import functions as F

VOCAB = "injury rate employee office number revenue market total growth accident site lost time".split()


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        positive = rng.random() < 0.3
        pool = VOCAB[:6] if positive else VOCAB[4:]
        rows.append((i, " ".join(rng.choices(pool, k=rng.randint(1, 9))), int(positive)))
    rows += [(120, "the of", 0), (121, "unseen zebra", 1)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, passages):
    return spark.createDataFrame(passages, "doc_id bigint, text string, class int")


def grams(text, high):
    words = [w for w in text.split() if w not in ("the", "of")]
    return Counter(" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1))


def plain_model(rows, alpha, high):
    sums, seen = [Counter(), Counter()], set()
    for _, text, label in rows:
        counts = grams(text, high)
        length = math.sqrt(sum(n * n for n in counts.values())) or 1
        for term, n in counts.items():
            sums[label][term] += n / length
            seen.add(term)
    totals = [sum(s.values()) for s in sums]
    prior = [math.log(sum(r[2] == c for r in rows) / len(rows)) for c in (0, 1)]

    def likelihood(text):
        counts = {t: n for t, n in grams(text, high).items() if t in seen}
        length = math.sqrt(sum(n * n for n in counts.values())) or 1
        s = [prior[c] + sum(n * (math.log(sums[c][t] + alpha) - math.log(totals[c] + alpha * len(seen)))
                            for t, n in counts.items()) / length for c in (0, 1)]
        return 1 / (1 + math.exp(s[0] - s[1]))

    return likelihood


@pytest.mark.parametrize("high", [1, 3])
def test_naive_bayes(frame, passages, high):
    vocabulary, totals = naive_bayes.train(frame, 0.25, (1, high))
    likelihood = plain_model(passages, 0.25, high)
    for r in naive_bayes.score(frame, ["doc_id"], vocabulary, totals, (1, high)).collect():
        assert r["likelihood"] == pytest.approx(likelihood(r["text"]), abs=1e-9)
        assert r["predicted_class"] == int(r["likelihood"] > 0.5)


def test_cross_validation(frame, passages):
    folded = sampling.stratified_folds(frame, F.col("doc_id"), 5)
    fold_of = {r["doc_id"]: r["fold"] for r in folded.collect()}
    by_class = [Counter(fold_of[i] for i, _, c in passages if c == label) for label in (0, 1)]
    assert all(max(c.values()) - min(c.values()) <= 1 for c in by_class)
    got = naive_bayes.cross_validate(folded, "doc_id", [0.1, 1.0], (1, 2), 5).collect()
    assert len(got) == 2 * len(passages)
    text_of = {i: t for i, t, _ in passages}
    for alpha in (0.1, 1.0):
        models = {k: plain_model([r for r in passages if fold_of[r[0]] != k], alpha, 2) for k in range(5)}
        for r in got:
            if r["alpha"] == alpha:
                assert r["likelihood"] == pytest.approx(models[r["fold"]](text_of[r["doc_id"]]), abs=1e-9)


@pytest.mark.parametrize("held", [0, 2, 1000])
def test_frequent_terms_are_summed_where_they_are_read(spark, monkeypatch, held):
    """Only the terms that are not held are shuffled; scores are the same however many are."""
    labelled = spark.createDataFrame([("alpha beta beta gamma", 1), ("alpha delta", 0), ("alpha gamma gamma", 0)], "text string, class int")
    vocabulary, totals = naive_bayes.train(labelled, 0.5)
    texts = ["alpha alpha beta omega", "omega", None, "gamma delta beta", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(naive_bayes, "HELD_TERMS", held)
    counts = []
    monkeypatch.setattr(naive_bayes, "materialise", lambda df: counts.append(df) or df)
    got = {r["doc_id"]: r["likelihood"] for r in naive_bayes.score(rows, ["doc_id"], vocabulary, totals).collect()}
    assert {t["term"] for r in counts[0].collect() for t in r["rest"]} == {
        0: {"alpha", "beta", "gamma", "delta", "omega"}, 2: {"gamma", "delta", "omega"}, 1000: {"omega"}}[held]
    thetas, prior = {r["term"]: (r["theta0"], r["theta1"]) for r in vocabulary.collect()}, totals.first()
    for i, text in enumerate(texts):
        n = {t: c for t, c in Counter((text or "").split()).items() if t in thetas}
        length = math.sqrt(sum(c * c for c in n.values())) or 1.0
        s0, s1 = (prior[f"prior{k}"] + sum(c * thetas[t][k] for t, c in n.items()) / length for k in (0, 1))
        assert got[i] == pytest.approx(1 / (1 + math.exp(s0 - s1)), abs=1e-12)


def test_frequent_terms_are_gathered_by_a_task(spark, monkeypatch):
    """Of a limit at the root of a plan, every partition sends as many rows to the driver."""
    labelled = spark.createDataFrame([("alpha beta beta gamma", 1), ("alpha delta", 0)], "text string, class int")
    vocabulary, totals = naive_bayes.train(labelled, 0.5)
    plans = []

    def recorded(self, collect=type(vocabulary).collect):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(vocabulary), "collect", recorded)
    naive_bayes.score(labelled.withColumn("doc_id", F.monotonically_increasing_id()), ["doc_id"], vocabulary, totals)
    assert any("TakeOrderedAndProject" in plan for plan in plans)
    assert not any("TakeOrderedAndProject" in line for plan in plans for line in plan.split("\n")[:2])


def test_texts_are_read_in_pieces_of_characters():
    """A batch is so many rows, however long: words are held for a piece of it, in order, with nulls and empty texts."""
    texts = ["x" * (features.PIECE // 2 + 1), None, "", "short", "y" * (3 * features.PIECE), None] * 3
    pieces = list(features._pieces(iter([pa.array(texts), pa.array([], pa.string()), pa.array([None], pa.string())])))
    assert [t for piece in pieces for t in piece] == [*texts, None]
    assert len(pieces) > 3 and all(sum(len(t or "") for t in piece[:-1]) < features.PIECE for piece in pieces)


def test_long_batches_keep_their_rows(spark):
    """One batch of several pieces: every row gets its own counts."""
    frame = spark.range(40).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.concat(F.lit("term"), F.col("id"), F.lit(" ")), 9000)).alias("text")).coalesce(1)
    got = {r["id"]: (r["terms"], r["words"]) for r in features.term_counts(frame).select(
        "id", "terms", F.size(features.words("text")).alias("words")).collect()}
    assert got == {i: ([(f"term{i}", 9000)], 9000) if i % 7 else ([], None) for i in range(40)}


def test_term_counts_and_words(spark):
    rows = spark.createDataFrame([("  The Rate, the RATE\n3.5 it's “x” ",), ("",), ("of the",)], "text string")
    got = [{t["term"]: t["n"] for t in r["terms"]} for r in features.term_counts(rows, ngram_range=(1, 2)).collect()]
    assert got[0]["rate"] == 2 and got[0]["rate rate"] == 1 and "3.5" in got[0] and "the" not in got[0] and "" not in got[0]
    assert got[1] == {} and got[2] == {}


def test_masks(spark):
    rows = spark.createDataFrame([("2020",), ("in 2020",), ("3.5%",), ("a 1 b 22.75",), ("1820",)], "t string")
    assert [r[0] for r in rows.select(mask_numbers("t")).collect()] == ["YEAR", "in NUM", "NUM", "a NUM b NUM", "NUM"]
    assert rows.select(mask_numbers("t", years=False)).first()[0] == "NUM"


def test_balance(frame, passages):
    positives = sum(c for _, _, c in passages)
    for ratio in (1, 3):
        counts = Counter(r["class"] for r in sampling.balance_classes(frame, F.col("doc_id"), ratio).collect())
        assert counts == {1: positives, 0: min(ratio * positives, len(passages) - positives)}
    few = frame.filter("class = 1").unionByName(frame.filter("class = 0").limit(3))
    assert sampling.balance_classes(few, F.col("doc_id")).count() == positives + 3  # positives are not fewer
    assert training.prepare(frame, "doc_id", "1:3", True).count() == min(4 * positives, len(passages))


def test_split(frame, passages):
    counts = Counter(r["is_train"] for r in sampling.train_test_split(frame, F.col("doc_id")).collect())
    assert counts[True] == int(len(passages) * 0.8) and sum(counts.values()) == len(passages)


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4, "class int, prediction int")
    s = evaluate.classification_scores(rows).first()
    assert (s["accuracy"], s["precision"], s["recall"]) == (0.7, 0.75, 0.6) and s["f1"] == pytest.approx(2 / 3)
    none = evaluate.classification_scores(rows.withColumn("prediction", F.lit(0))).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_categories(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.65), (0, 0.7), (0, 0.2)], "class int, probability double")
    assert [r[0] for r in rows.select(categories.decide("probability")).collect()] == [1, 0, 1, 0]
    s = evaluate.category_scores(categories.label_pairs(rows)).first()
    assert s["textcat_p"] == pytest.approx(6 / 8) and s["textcat_f"] == pytest.approx(0.75)
    assert categories.encode_labels(rows).first()["cats"] == {"healthcare": True, "no_healthcare": False}


@pytest.mark.parametrize("classifier", ["LinearSVC", "SGDClassifier", "LogisticRegression"])
def test_linear_models_learn(frame, classifier):
    rows = frame.filter("doc_id < 120")
    model = linear.train_linear(rows, classifier, alpha=1e-3)
    out = model.predict(rows)
    assert out.filter("prediction = class").count() > 100
    assert model.terms.count() == len(VOCAB)


def dense(frame):
    """Unit rows with a constant term, signs, and the vocabulary."""
    import numpy as np

    rows = frame.collect()
    counted = {r["doc_id"]: {t["term"]: t["n"] for t in r["terms"]} for r in features.term_counts(frame).collect()}
    vocabulary = sorted({t for c in counted.values() for t in c})
    x = np.array([[counted[r["doc_id"]].get(t, 0) for t in vocabulary] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.hstack([x, np.ones((len(x), 1))]), np.array([1.0 if r["class"] == 1 else -1.0 for r in rows]), vocabulary, [r["doc_id"] for r in rows]


def gradient(x, y, w, classifier, penalty):
    """Of the mean loss plus the penalty, stated anew."""
    import numpy as np

    margin = y * (x @ w)
    pull = {"LinearSVC": 2 * np.maximum(0, 1 - margin), "SGDClassifier": np.clip((1 - margin) / linear.ROUNDED, 0, 1),
            "LogisticRegression": 1 / (1 + np.exp(margin))}[classifier]
    return penalty * w - (y * pull) @ x / len(y)


@pytest.mark.parametrize("classifier, values, block_rows, tolerance", [
    ("LinearSVC", (0.01, 1.0, 100.0), 512, 1e-9), ("SGDClassifier", (1e-3, 0.1), 512, 1e-9), ("LogisticRegression", (0.01, 1.0), 512, 1e-9),
    ("LinearSVC", (0.01, 1.0), 80, 1e-3), ("LogisticRegression", (1.0, 10.0), 80, 1e-3), ("SGDClassifier", (0.2,), 80, 1e-3)])
def test_models_are_optimal(frame, classifier, values, block_rows, tolerance):
    """The gradient vanishes, for one block and for several that need rounds; C matters."""
    import numpy as np

    x, y, vocabulary, _ = dense(frame)
    settings = [linear.Setting(classifier, v) for v in values]
    counted = features.term_counts(frame).withColumn("fold", F.lit(0)).select("doc_id", "class", "fold", "terms")
    terms, bias = linear.fit_models(counted, ["doc_id"], settings, tolerance, block_rows)
    got = {r["term"]: r for r in terms.collect()}
    assert set(got) == set(vocabulary)
    lengths = []
    for i, s in enumerate(settings):
        w = np.array([got[t][f"t{i}"] for t in vocabulary] + [bias[i]])
        assert np.linalg.norm(gradient(x, y, w, classifier, s.penalty(len(y)))) < 1.01 * tolerance * linear.STEEPNESS[classifier]
        lengths.append(np.linalg.norm(w))
    assert len(values) == 1 or max(lengths) > 1.5 * min(lengths)


def test_folds_stay_out(frame):
    """A model of a fold is the model of the other rows, and a model's rows are scored by the models that left them out."""
    folded = sampling.stratified_folds(frame, F.col("doc_id"), 3)
    out = {(r["value"], r["doc_id"]): r["score"] for r in linear.cross_validate_linear(
        folded, "doc_id", [("LinearSVC", 0.1), ("LinearSVC", 10.0)], 3).collect()}
    rest, own = folded.filter("fold <> 1").drop("fold"), folded.filter("fold = 1").drop("fold")
    for c in (0.1, 10.0):
        for r in linear.train_linear(rest, "LinearSVC", C=c).predict(own).collect():
            assert r["score"] == pytest.approx(out[c, r["doc_id"]], abs=1e-5)


def test_odd_training_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, class int")
    assert linear.train_linear(empty).terms.count() == 0
    one = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "good", 1)], "doc_id long, text string, class int")
    assert [r["prediction"] for r in linear.train_linear(one).predict(one).orderBy("doc_id").collect()] == [1, 1, 1]


def test_passages_are_not_broadcast_in_rounds(spark):
    """The inner products of a round are one row per passage, however small that is measured."""
    weights = spark.createDataFrame([(i, t, 0.5) for i in range(6) for t in "ab"], "id long, term string, w double")
    state = spark.createDataFrame([("a", [1.0]), ("b", [3.0]), (linear.BIAS, [0.25])], "term string, x array<double>")
    out = linear._scored(spark.range(7), weights, state, "x", ["id"], 1)
    assert {r["id"]: r["z"][0] for r in out.collect()} == {i: 2.25 if i < 6 else 0.25 for i in range(7)}
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftOuter" in line and "[id#" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)


def test_rounds_need_a_shared_folder(frame, monkeypatch):
    monkeypatch.setattr("leafsift.session.shared_dir", lambda spark: None)
    with pytest.raises(ValueError, match="checkpoint"):
        linear.train_linear(frame)


def test_rounds_that_cannot_end_raise(frame):
    with pytest.raises(RuntimeError):
        linear.train_linear(frame, tolerance=0.0, most_rounds=1)


def test_training_errors(frame):
    with pytest.raises(ValueError):
        training.train_classifier([("a", 1)])
    with pytest.raises(ValueError):
        linear.train_linear(frame.drop("class"))
    with pytest.raises(ValueError):
        linear.train_linear(frame, "Forest")


def test_grid_small(frame):
    grid = training.grid_search_linear(frame, "doc_id", [("LinearSVC", 1.0), ("SGDClassifier", 0.1)], [1], k=2).unionByName(
        training.grid_search_nb(frame, "doc_id", [0.1, 1.0], [1], k=2))
    rows = grid.collect()
    assert len(rows) == 4 and all(0 <= r["f1"] <= 1 for r in rows)


def test_top_terms(frame):
    vocabulary, _ = naive_bayes.train(frame, 1.0)
    rows = naive_bayes.top_terms(vocabulary, 3).collect()
    weights = sorted((r["theta1"], r["term"]) for r in vocabulary.collect())
    assert {(r["weight"], r["term"]) for r in rows if r["side"] == "lowest"} == set(weights[:3])
    assert {(r["weight"], r["term"]) for r in rows if r["side"] == "highest"} == set(weights[-3:])


def test_all_scorers(spark, make_blocks, frame):
    blocks = make_blocks({"A_Annual_Report_2020.pdf": {
        1: ["We employ 12 people.", "The average number of employees grew."], 2: ["12 agency contractors."],
        3: ["Private medical insurance cover for all."], 4: ["LTIFR 1.2", "TRIFR 2"], 5: ["the ceo pay ratio"]}})
    train = spark.createDataFrame(
        [("average number employees people", 1), ("medical insurance cover", 1), ("agency contractors", 1), ("ceo pay ratio", 1),
         ("weather rain", 0), ("other words", 0)], "text string, class int")
    nb = (*naive_bayes.train(train, 0.1), (1, 1))
    models = {"n_employees": nb, "ceo_pay_ratio": nb, "n_contractors": linear.train_linear(train),
              "healthcare": linear.train_category(train, alpha=1e-3)}
    out = {r["metric"]: r for r in assess.assess_metrics(blocks, [*models, "ltifr", "trifr"], models).collect()}
    assert {m: r["predicted_page"] for m, r in out.items()} == {
        "n_employees": [1, 1], "n_contractors": [2], "healthcare": [3], "ltifr": [4], "trifr": [4], "ceo_pay_ratio": [5]}
    with pytest.raises(ValueError):
        assess.assess_metric(blocks, "n_employees")
