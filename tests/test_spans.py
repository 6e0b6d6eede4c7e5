"""Linear models as sums of their passages: the same minima as over tables, in few rounds."""

import random

import numpy as np
import pytest
from leafsift.operators import features, linear, sampling, spans
from leafsift_checks.queries import QUERIES
from pyspark.sql import functions as F

VOCAB = [f"word{i}" for i in range(60)]
NAMES = ["t08_sgd_hinge", "h01_category_model", "h04_category_scores", "h06_rounded_probability", "h05_decide", "s06_saved_linear_model", "t07_linear_svc"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        positive = rng.random() < 0.4
        rows.append((i, " ".join(rng.choices(VOCAB[:40] if positive else VOCAB[20:], k=rng.randint(1, 12)) + [f"own{i}"]), int(positive)))
    rows += [(150, None, 0), (151, "the of", 1), (152, rows[0][1], rows[0][2]), (153, "zebra", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, class int")


@pytest.fixture(scope="module")
def counted(frame):
    return features.term_counts(frame).withColumn("fold", F.lit(0)).select("doc_id", "class", "fold", "terms").cache()


def steepness(counted, terms, bias, setting, i=0):
    """The gradient of the mean loss plus the penalty, stated anew."""
    weights, rows = {r["term"]: r[f"t{i}"] for r in terms.collect()}, counted.collect()
    seen = sorted({t["term"] for r in rows for t in r["terms"]})
    assert set(weights) == set(seen)
    x = np.array([[{t["term"]: t["n"] for t in r["terms"]}.get(w, 0) for w in seen] for r in rows], float)
    x = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(x), 1))])
    y, w = np.array([1.0 if r["class"] == 1 else -1.0 for r in rows]), np.array([*[weights[t] for t in seen], bias[i]])
    pull = setting.local(y * (x @ w))[1]
    return np.linalg.norm(setting.penalty(len(y)) * w - (y * pull) @ x / len(y)) / linear.STEEPNESS[setting.classifier]


@pytest.mark.parametrize("classifier, values", [
    ("LinearSVC", (0.01, 1.0)), ("SGDClassifier", (0.01,)), ("LogisticRegression", (1.0,))])
def test_minima_of_several_blocks_in_few_rounds(counted, classifier, values):
    settings = [linear.Setting(classifier, v) for v in values]
    terms, bias = linear.fit_models(counted, ["doc_id"], settings, 1e-9, block_rows=40, most_rounds=150)
    assert all(steepness(counted, terms, bias, s, i) < 1.01e-9 for i, s in enumerate(settings))


@pytest.mark.parametrize("limits", [
    {"GROUP_HELD": 1, "BLOCK": 50, "PART": 20}, {"HELD": 2 * 9 * 154, "GROUP_HELD": 2 * 9 * 154, "STRIP": 7}])
def test_limits_do_not_change_minima(counted, monkeypatch, limits):
    """Models in groups, sums in blocks, small parts, directions that are given up."""
    settings = [linear.Setting("LinearSVC", 1.0), linear.Setting("LogisticRegression", 0.1)]
    want, known = linear.fit_models(counted, ["doc_id"], settings, 1e-8, block_rows=40)
    for name, value in limits.items():
        monkeypatch.setattr(spans, name, value)
    terms, bias = linear.fit_models(counted, ["doc_id"], settings, 1e-8, block_rows=40)
    assert bias == pytest.approx(known, abs=1e-5)
    want, got = ({r["term"]: (r["t0"], r["t1"]) for r in t.collect()} for t in (want, terms))
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-5) for t in want)


def test_more_passages_than_the_driver_holds_take_rounds_over_tables(counted, monkeypatch):
    monkeypatch.setattr(spans, "HELD", 100)
    monkeypatch.setattr(spans, "Postings", None)
    s = linear.Setting("LinearSVC", 1.0)
    terms, bias = linear.fit_models(counted, ["doc_id"], [s], 1e-2, block_rows=80)
    assert steepness(counted, terms, bias, s) < 1.01e-2


def test_folds_are_scored_as_by_tables(frame, monkeypatch):
    """Terms that only a passage's own fold has count neither for its score nor for its length."""
    folded, settings = sampling.stratified_folds(frame, F.col("doc_id"), 3), [("LinearSVC", 0.1), ("SGDClassifier", 0.01)]

    def scored():
        rows = linear.cross_validate_linear(folded, "doc_id", settings, 3, (1, 2)).collect()
        return {(r["classifier"], r["value"], r["doc_id"], r["class"], r["fold"]): (r["score"], r["prediction"]) for r in rows}

    with monkeypatch.context() as held:
        held.setattr(spans, "fits", lambda passages: False)
        want = scored()
    # A table of all terms by all models is never made.
    monkeypatch.setattr(linear, "fit_models", None)
    got = scored()
    assert len(want) == 2 * 154 and got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=2e-4) for k in want)
    assert all(got[k][1] == want[k][1] for k in want if abs(want[k][0]) > 2e-4)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("labelled"))
    marks = [(i, int(i % 3 == 0)) for i in range(1200)]
    docs = [(i, " ".join(rng.choices(VOCAB[:40] if c else VOCAB[20:], k=8)), "web") for i, c in marks]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_needs_no_rounds_over_tables(spark, tables, monkeypatch, name):
    """Rounds over tables are a dozen jobs each; more than a block of passages takes none."""
    def fail(*_):
        raise AssertionError("a round over tables")
    monkeypatch.setattr(linear, "_scored", fail)
    assert QUERIES[name](spark, tables).count() > 0
