"""Linear text classifiers as tables: squared hinge, hinge and logistic loss with L2 penalty.

A model is a table ``term, theta1`` and a bias, the weight of a constant term
that is penalised like all others. It is the minimum of the mean loss plus the
penalty, up to a stopping test on the gradient. More passages than one block,
but no more than the driver can hold some vectors of, are summed (``spans``).
Otherwise there are two steps:

* Blocks of passages are solved on their own, by Newton steps in the span of
  a block's passages, from the strongest penalty to the weakest. The average
  of the blocks' solutions is the start; of a single block it is the solution.
* Rounds of limited-memory quasi-Newton steps over the term tables lead from
  there to the minimum. Vectors stay tables; the driver holds their dot
  products. A round is one join by term each for scores and gradient, and a
  line search on the summed losses, which needs the scores alone.

Several models (settings, folds) go through the same rounds as elements of the
same arrays; those that have converged leave them. No vocabulary passes through
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import explode_rows, shuffled_join
from leafsift.operators import spans
from leafsift.operators.features import term_counts, term_weights
from leafsift.session import materialise

# Copies of a term row when passages are scored, so that a frequent term is spread over tasks.
TERM_SALTS = 8
# Passages of a block, terms of a block taken at once, pairs of vectors that a quasi-Newton step looks back on.
BLOCK_ROWS, BLOCK_TERMS, MEMORY = 512, 8192, 5
# The hinge is rounded over this part of the margin, which makes it smooth and changes a loss by half of it at most.
ROUNDED = 0.01
# The steepest slope of each loss at zero; a gradient at zero is at most about as long.
STEEPNESS = {"LinearSVC": 2.0, "SGDClassifier": 1.0, "LogisticRegression": 0.5}
CLASSIFIERS = tuple(STEEPNESS)
# The constant term; no word is empty.
BIAS = ""


@dataclass(frozen=True)
class Setting:
    """One model to fit: ``value`` is C for LinearSVC, else alpha; rows of ``fold`` stay out."""

    classifier: str
    value: float
    fold: int | None = None

    def penalty(self, rows: int) -> float:
        """L2 strength beside the mean loss of ``rows`` passages."""
        rows = max(rows, 1)
        return {"LinearSVC": 1.0 / (self.value * rows), "SGDClassifier": self.value, "LogisticRegression": self.value / rows}[self.classifier]

    def pull(self, margin: Column) -> Column:
        """How fast the loss falls with the margin."""
        return {
            "LinearSVC": 2.0 * F.greatest(F.lit(0.0), 1.0 - margin),
            "SGDClassifier": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - margin) / ROUNDED)),
            "LogisticRegression": 1.0 / (1.0 + F.exp(margin)),
        }[self.classifier]

    def loss(self, margin: Column) -> Column:
        short = F.greatest(F.lit(0.0), 1.0 - margin)
        return {
            "LinearSVC": short * short,
            "SGDClassifier": F.when(short < ROUNDED, short * short / (2 * ROUNDED)).otherwise(short - ROUNDED / 2),
            "LogisticRegression": F.greatest(F.lit(0.0), -margin) + F.log1p(F.exp(-F.abs(margin))),
        }[self.classifier]

    def local(self, margin: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Summed loss, pulls and curvatures of the margins of a block."""
        short = np.maximum(0.0, 1.0 - margin)
        if self.classifier == "LinearSVC":
            return float(short @ short), 2.0 * short, 2.0 * (short > 0)
        if self.classifier == "SGDClassifier":
            near = short < ROUNDED
            loss = np.where(near, short * short / (2 * ROUNDED), short - ROUNDED / 2)
            return float(loss.sum()), np.minimum(1.0, short / ROUNDED), (near & (short > 0)) / ROUNDED
        pull = np.exp(-np.logaddexp(0.0, margin))
        return float(np.logaddexp(0.0, -margin).sum()), pull, pull * (1.0 - pull)


def block_solution(gram: np.ndarray, setting: Setting, penalty: float, beta: np.ndarray) -> np.ndarray:
    """The pulls at the minimum over passages with inner products ``gram`` (times both signs), from ``beta`` on.

    At the minimum the weights are the passages' sum by sign and pull, over
    penalty and number. A Newton step solves for the pulls that hold at the
    margins they lead to; it is halved until the loss falls.
    """
    scale = penalty * len(gram)
    margin = gram @ beta / scale

    def value(b: np.ndarray, m: np.ndarray) -> float:
        return 0.5 * float(b @ m) + setting.local(m)[0]

    for _ in range(200):
        _, pull, curvature = setting.local(margin)
        if np.abs(beta - pull).max() <= 1e-13:
            break
        step = np.linalg.solve(np.eye(len(gram)) + curvature[:, None] * gram / scale, pull + curvature * margin) - beta
        change = gram @ step / scale
        here, size = value(beta, margin), 1.0
        # The objective's slope along the step, which is downwards.
        slope = float(change @ (beta - pull))
        while size > 1e-9 and value(beta + size * step, margin + size * change) > here + 1e-4 * size * slope:
            size /= 2
        if size <= 1e-9:
            break
        beta, margin = beta + size * step, margin + size * change
    return setting.local(margin)[1]


def _start(settings: Sequence[Setting], rows: Sequence[int]):
    """Solve a block for all settings: ``term, x``, each solution in proportion to the block's share of the passages."""

    def solve(table: pa.Table) -> pa.Table:
        y, fold = table["y"].to_numpy(), table["fold"].to_numpy()
        terms = table["terms"].combine_chunks()
        owner = np.repeat(np.arange(len(y)), np.diff(terms.offsets.to_numpy()))
        entries = terms.flatten()
        names = entries.field("term").dictionary_encode()
        n = entries.field("n").to_numpy().astype(float)
        length = np.sqrt(np.bincount(owner, n * n, len(y)))
        weight = n / length[owner]
        code, names = names.indices.to_numpy(), names.dictionary
        order = np.argsort(code, kind="stable")
        owner, weight, code = owner[order], weight[order], code[order]
        edges = np.searchsorted(code, np.arange(0, len(names) + BLOCK_TERMS, BLOCK_TERMS))

        def strips() -> Iterator[np.ndarray]:
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                dense = np.zeros((len(y), min(BLOCK_TERMS, len(names) - i * BLOCK_TERMS)))
                dense[owner[a:b], code[a:b] - i * BLOCK_TERMS] = weight[a:b]
                yield dense

        gram = np.ones((len(y), len(y)))
        for dense in strips():
            gram += dense @ dense.T
        gram *= y[:, None] * y
        parts = np.zeros((len(y), len(settings)))
        before: dict[tuple[str, int | None], np.ndarray] = {}
        for i in sorted(range(len(settings)), key=lambda i: -settings[i].penalty(rows[i])):
            s = settings[i]
            own = np.flatnonzero(fold != s.fold) if s.fold is not None else np.arange(len(y))
            if not len(own):
                continue
            penalty = s.penalty(rows[i])
            pull = block_solution(gram[np.ix_(own, own)], s, penalty, before.get((s.classifier, s.fold), np.zeros(len(own))))
            before[s.classifier, s.fold] = pull
            parts[own, i] = y[own] * pull / (penalty * len(own)) * (len(own) / rows[i])
        x = np.concatenate([dense.T @ parts for dense in strips()] + [parts.sum(axis=0)[None]])
        return pa.table({"term": pa.concat_arrays([names.cast(pa.string()), pa.array([BIAS])]),
                         "x": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())})

    return solve


def _sums(of: str, models: int, times: Column | None = None) -> Column:
    """Element by element, the sum of an array column."""
    return F.array(*[F.coalesce(F.sum(F.get(of, F.lit(i)) * times if times is not None else F.get(of, F.lit(i))), F.lit(0.0)) for i in range(models)])


def _picked(of: str, places: Sequence[int]) -> Column:
    return F.array(*[F.get(of, F.lit(int(k))) for k in places]).alias(of)


def _vectors(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Vectors by name, row and model."""
    out = [batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False) for n in names]
    return np.stack([v.reshape(batch.num_rows, -1) for v in out])


def _dots(state: DataFrame, names: Sequence[str], models: int) -> np.ndarray:
    """Dot products of the named vectors: model, vector, vector."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, len(names), len(names)))
        for batch in filter(len, batches):
            v = _vectors(batch, names)
            total += np.einsum("arm,brm->mab", v, v)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "part"])

    found = state.select(*names).mapInArrow(partial, "at long, part double").groupBy("at").agg(F.sum("part").alias("v"))
    out = np.zeros(models * len(names) ** 2)
    for row in found.collect():
        out[row["at"]] = row["v"]
    return out.reshape(models, len(names), len(names))


def _mixed(state: DataFrame, names: Sequence[str], new: dict[str, np.ndarray], keep: dict[str, str]) -> DataFrame:
    """Columns ``new``, combinations of the named vectors with weights by vector and model, beside ``keep`` (new name: old name)."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            v = _vectors(batch, names)
            made = [np.einsum("brm,bm->rm", v, w) for w in new.values()]
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * v.shape[2]
            arrays = [pa.ListArray.from_arrays(offsets, m.ravel()) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(batch.schema.get_field_index(o)) for o in keep.values()], *arrays],
                                             names=["term", *keep, *new])

    columns = [f"{n} array<double>" for n in (*keep, *new)]
    needed = list(dict.fromkeys([*names, *keep.values()]))
    return state.select("term", *needed).mapInArrow(mix, ", ".join(["term string", *columns]))


def _direction(dots: np.ndarray, pairs: int) -> np.ndarray:
    """Weights of ``g, s1.., y1..`` in the quasi-Newton step of one model, from their dot products (newest pair first)."""
    size = 1 + 2 * pairs
    q, alphas = np.zeros(size), {}
    q[0] = 1.0
    usable = [i for i in range(pairs) if dots[1 + i, 1 + pairs + i] > 0]
    for i in usable:
        alphas[i] = (q @ dots[:, 1 + i]) / dots[1 + i, 1 + pairs + i]
        q[1 + pairs + i] -= alphas[i]
    if usable:
        q *= dots[1 + usable[0], 1 + pairs + usable[0]] / dots[1 + pairs + usable[0], 1 + pairs + usable[0]]
    for i in reversed(usable):
        q[1 + i] += alphas[i] - (q @ dots[:, 1 + pairs + i]) / dots[1 + i, 1 + pairs + i]
    return -q


def fit_models(
    counted: DataFrame, ident: Sequence[str], settings: Sequence[Setting], tolerance: float = 1e-6, block_rows: int = BLOCK_ROWS,
    most_rounds: int = 1000,
) -> tuple[DataFrame, list[float]]:
    """Fit all ``settings`` on ``ident, class, fold, terms``: a table ``term, t0, t1, ...`` and the biases.

    A model is done when its gradient is shorter than ``tolerance`` times the
    steepest slope of its loss at zero. ``most_rounds`` guards against a
    tolerance beyond the reach of floating point: it raises an error and never
    returns an unfinished model. Needs a shared folder for its tables.
    """
    ident = list(ident)
    passages = counted.count()
    if block_rows < passages and spans.fits(passages):
        postings, sums = _summed(counted, settings, tolerance, most_rounds)
        return postings.terms(sums), sums.sum(axis=0).tolist()
    counted = counted.withColumn("y", F.when(F.col("class") == 1, 1.0).otherwise(-1.0))
    weights = materialise(term_weights(counted.select(*ident, "terms")).select(*ident, "term", "w"), needed=True)
    passages = materialise(counted.select(*ident, "fold", "y"), needed=True)
    of_fold = {r["fold"]: r["count"] for r in passages.groupBy("fold").count().collect()}
    rows = [max(1, sum(n for fold, n in of_fold.items() if s.fold is None or fold != s.fold)) for s in settings]
    penalty = np.array([s.penalty(n) for s, n in zip(settings, rows)])
    blocks = max(1, -(-sum(of_fold.values()) // block_rows))
    solved = counted.select("y", "fold", "terms", F.pmod(F.xxhash64(*ident), F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(
        _start(settings, rows), "term string, x array<double>")
    start = solved if blocks == 1 else solved.groupBy("term").agg(_sums("x", len(settings)).alias("x"))
    state = materialise(start, needed=True)
    active, done, pairs, scored = list(range(len(settings))), [], 0, None
    for _ in range(most_rounds):
        if not active:
            break
        models = len(active)
        if scored is None:
            scored = materialise(_scored(passages, weights, state, "x", ident, models), needed=True)
        # The gradient at x, and with it the newest pair of changes.
        slopes = scored.select(*ident, F.array(*[
            F.when(F.lit(True) if settings[i].fold is None else F.col("fold") != settings[i].fold,
                   -F.col("y") * settings[i].pull(F.col("y") * F.get("z", F.lit(k)))).otherwise(0.0) / rows[i]
            for k, i in enumerate(active)]).alias("d"))
        slopes = materialise(slopes, needed=True)
        fall = shuffled_join(weights, slopes, ident).groupBy("term").agg(_sums("d", models, F.col("w")).alias("fall")).unionByName(
            slopes.agg(_sums("d", models).alias("fall")).select(F.lit(BIAS).alias("term"), "fall"))
        state = shuffled_join(state, fall, ["term"], "left").withColumn("fall", F.coalesce("fall", F.array(*[F.lit(0.0)] * models)))
        one = np.ones(models)
        older = {f"{v}{j + 1}": f"{v}{j}" for v in ("s", "y") for j in range(1, min(pairs, MEMORY - 1) + 1)} if pairs else {}
        new = {"g": np.stack([penalty[active], one])}
        names = ["x", "fall"]
        if "moved" in state.columns:
            pairs = min(pairs + 1, MEMORY)
            names += ["g", "moved"]
            new = {"g": np.stack([penalty[active], one, 0 * one, 0 * one]), "y1": np.stack([penalty[active], one, -one, 0 * one]),
                   "s1": np.stack([0 * one, 0 * one, 0 * one, one])}
        state = materialise(_mixed(state, names, new, {"x": "x", **older}), needed=True)
        basis = ["x", "g", *[f"s{j}" for j in range(1, pairs + 1)], *[f"y{j}" for j in range(1, pairs + 1)]]
        dots = _dots(state, basis, models)
        steep = np.array([STEEPNESS[settings[i].classifier] for i in active])
        open_ = np.flatnonzero(np.sqrt(dots[:, 1, 1]) > tolerance * steep)
        if 2 * len(open_) <= models:
            # At least half have converged: they leave, and the others go on in shorter arrays.
            gone = [k for k in range(models) if k not in set(open_.tolist())]
            done += [(active[k], materialise(state.select("term", F.get("x", F.lit(k)).alias(f"t{active[k]}")), needed=True)) for k in gone] if len(open_) else [
                (None, state.select("term", *[F.get("x", F.lit(k)).alias(f"t{active[k]}") for k in gone]))]
            active = [active[k] for k in open_]
            if not active:
                break
            state = materialise(state.select("term", *[_picked(c, open_) for c in basis]), needed=True)
            scored = materialise(scored.withColumn("z", _picked("z", open_)), needed=True)
            dots, open_, models = dots[open_], np.arange(len(active)), len(active)
        weight = np.zeros((len(basis), models))
        for k in open_:
            weight[1:, k] = _direction(dots[k][1:, 1:], pairs)
            if not pairs:
                weight[1, k] /= max(1.0, np.sqrt(dots[k, 1, 1]))
        state = materialise(_mixed(state, basis, {"step": weight}, {c: c for c in basis}), needed=True)
        scored = materialise(_scored(scored, weights, state, "step", ident, models, "dz"), needed=True)
        # Along the step: the penalty's part is known from the dot products, the losses are summed.
        slope = np.einsum("bm,mb->m", weight, dots[:, :, 1])
        cross = np.einsum("bm,mb->m", weight, dots[:, :, 0])
        square = np.einsum("am,mab,bm->m", weight, dots, weight)
        here = _losses(scored, settings, active, rows, np.zeros(models))
        size = np.where(np.isin(np.arange(models), open_), 1.0, 0.0)
        while True:
            there = _losses(scored, settings, active, rows, size) + penalty[active] * (size * cross + size**2 * square / 2)
            short = (size > 0) & (there > here + 1e-4 * size * slope + 1e-15)
            if not short.any():
                break
            size = np.where(short, np.where(size < 1e-9, 0.0, size / 2), size)
        scored = scored.withColumn("z", F.zip_with(F.col("z"), F.zip_with("dz", F.array(*[F.lit(float(v)) for v in size]), lambda a, b: a * b), lambda a, b: a + b)).drop("dz")
        at = {c: np.zeros((len(basis) + 1, models)) for c in ("x", "moved")}
        at["x"][0], at["x"][-1], at["moved"][-1] = 1.0, size, size
        state = _mixed(state, [*basis, "step"], at, {c: c for c in basis if c != "x"})
    else:
        raise RuntimeError(f"no convergence in {most_rounds} rounds; the tolerance may be too small")
    terms = done[0][1]
    for _, part in done[1:]:
        terms = terms.join(part, "term")
    terms = materialise(terms, needed=True)
    bias = terms.filter(F.col("term") == BIAS).first()
    return terms.filter(F.col("term") != BIAS), [bias[f"t{i}"] if bias else 0.0 for i in range(len(settings))]


def _summed(counted: DataFrame, settings: Sequence[Setting], tolerance: float, most_rounds: int) -> tuple[spans.Postings, np.ndarray]:
    """The passages as postings, and all ``settings`` as weights of the passages."""
    postings = spans.Postings(counted)
    rows = [max(1, int(np.sum(postings.fold != s.fold)) if s.fold is not None else postings.n) for s in settings]
    sums = spans.minimised(postings, settings, [s.penalty(n) for s, n in zip(settings, rows)], rows,
                           [tolerance * STEEPNESS[s.classifier] for s in settings], most_rounds)
    return postings, sums


def _scored(passages: DataFrame, weights: DataFrame, state: DataFrame, of: str, ident: list[str], models: int, out: str = "z") -> DataFrame:
    """Add the passages' inner products with a vector of all models."""
    sums = weights.join(state.select("term", of), "term").groupBy(*ident).agg(_sums(of, models, F.col("w")).alias("_sum"))
    zero = F.array(*[F.lit(0.0)] * models)
    # One row.
    constant = F.broadcast(state.filter(F.col("term") == BIAS).select(F.col(of).alias("_bias"), F.lit(1).alias("_one")))
    joined = shuffled_join(passages, sums, ident, "left").withColumn("_one", F.lit(1)).join(constant, "_one", "left")
    total = F.zip_with(F.coalesce("_sum", zero), F.coalesce("_bias", zero), lambda a, b: a + b)
    return joined.withColumn(out, total).drop("_sum", "_bias", "_one")


def _losses(scored: DataFrame, settings: Sequence[Setting], active: Sequence[int], rows: Sequence[int], size: np.ndarray) -> np.ndarray:
    """Mean losses at ``z + size * dz``."""
    sums = []
    for k, i in enumerate(active):
        s = settings[i]
        margin = F.col("y") * (F.get("z", F.lit(k)) + F.lit(float(size[k])) * F.get("dz", F.lit(k)))
        own = F.lit(True) if s.fold is None else F.col("fold") != s.fold
        sums.append(F.coalesce(F.sum(F.when(own, s.loss(margin))), F.lit(0.0)) / rows[i])
    return np.array(scored.agg(F.array(*sums).alias("v")).first()["v"])


def _scores(counted: DataFrame, ident: Sequence[str], terms: DataFrame, weights: dict[str, Column], known: Column | None = None) -> DataFrame:
    """``ident`` and for each of ``weights`` the sum of counts times it, over the length of the known terms."""
    ident = list(ident)
    occurrences = explode_rows(counted.withColumn("_salt", F.pmod(F.hash(*ident), F.lit(TERM_SALTS))), F.col("terms"), "_t").select(
        *ident, "fold", "_salt", F.col("_t.term").alias("term"), F.col("_t.n").cast("double").alias("n"))
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    hits = shuffled_join(occurrences, salted, ["term", "_salt"])
    hits = hits if known is None else hits.filter(known)
    length = F.sqrt(F.sum(F.col("n") * F.col("n")))
    return hits.groupBy(*ident).agg(*[(F.sum(F.col("n") * w) / length).alias(name) for name, w in weights.items()])


def decided(score: Column) -> Column:
    """1 for a positive score; nine places, so that the order of a sum does not decide."""
    return F.when(F.round(score, 9) > 0, 1).otherwise(0)


@dataclass
class LinearModel:
    """``term, theta1`` with the bias, the kind of classifier and the n-gram range of its input."""

    terms: DataFrame
    bias: float
    classifier: str
    ngram_range: tuple[int, int]

    def predict(self, passages: DataFrame, ident: Sequence[str] = ("doc_id",)) -> DataFrame:
        """Add ``score``, ``prediction`` (0/1), and ``probability`` for the logistic model, to passages with unique ``ident`` columns."""
        ident = list(ident)
        counted = term_counts(passages.select(*ident, "text"), ngram_range=self.ngram_range).withColumn("fold", F.lit(0))
        sums = _scores(counted, ident, self.terms, {"theta1": F.col("theta1")})
        out = shuffled_join(passages, sums, ident, "left").withColumn("score", F.lit(self.bias) + F.coalesce("theta1", F.lit(0.0)))
        out = out.withColumn("prediction", decided(F.col("score"))).drop("theta1")
        if self.classifier == "LogisticRegression":
            out = out.withColumn("probability", 1.0 / (1.0 + F.exp(-F.col("score"))))
        return out


def _checked(labelled: DataFrame, classifier: str) -> None:
    if not {"text", "class"} <= set(labelled.columns):
        raise ValueError("labelled passages need the columns text and class")
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier!r}; known: {', '.join(CLASSIFIERS)}")


def train_linear(
    labelled: DataFrame,
    classifier: str = "LinearSVC",
    C: float = 1.0,
    alpha: float = 1.0,
    ngram_range: tuple[int, int] = (1, 1),
    **options: float,
) -> LinearModel:
    """Fit on ``text, class``. ``C`` is for LinearSVC, ``alpha`` for the others; ``options`` are those of ``fit_models``."""
    _checked(labelled, classifier)
    # Equal passages of a class count as often as they occur, so a hash of both may name them.
    named = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "class").withColumn("_id", F.md5("text")).groupBy("_id", "class").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("_times"))
    named = named.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).withColumn("fold", F.lit(0))
    counted = materialise(term_counts(named, ngram_range=ngram_range).select("_id", "class", "_nth", "fold", "terms"))
    terms, bias = fit_models(counted.withColumn("_class", F.col("class")), ["_id", "_class", "_nth"],
                             [Setting(classifier, C if classifier == "LinearSVC" else alpha)], **options)
    return LinearModel(terms.withColumnRenamed("t0", "theta1"), bias[0], classifier, ngram_range)


def train_category(labelled: DataFrame, ngram_range: tuple[int, int] = (1, 1), alpha: float = 1.0) -> LinearModel:
    """Two-category model with probabilities."""
    return train_linear(labelled, "LogisticRegression", alpha=alpha, ngram_range=ngram_range)


def cross_validate_linear(
    folded: DataFrame, ident: str, settings: Sequence[tuple[str, float]], k: int, ngram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """Out-of-fold ``classifier, value, ident, class, fold, score, prediction`` for all settings in the same rounds.

    Terms are counted once; the folds of all settings are fitted together.
    """
    for classifier, _ in settings:
        _checked(folded, classifier)
    counted = materialise(term_counts(folded.select(ident, "class", "fold", "text"), ngram_range=ngram_range).drop("text"))
    models = [Setting(c, v, f) for c, v in settings for f in range(k)]
    passages = counted.count()
    if spans.fits(passages):
        # Of a few passages the minimum is as good as exact.
        return _cross_scored(*_summed(counted, models, 1e-6 if passages > BLOCK_ROWS else 1e-10, 1000), ident, settings, k)
    terms, bias = fit_models(counted, [ident], models)
    seen = explode_rows(counted, F.col("terms"), "_t").groupBy(F.col("_t.term").alias("term")).agg(
        F.array(*[F.count_if(F.col("fold") != f) for f in range(k)]).alias("_seen"))
    # A passage meets the models that left its fold out, and of those only terms of their training rows.
    own = terms.join(seen, "term").select("term", "_seen", *[
        F.array(*[F.col(f"t{j * k + f}") for f in range(k)]).alias(f"_s{j}") for j in range(len(settings))])
    fold = F.col("fold")
    sums = _scores(counted, [ident], own, {f"_m{j}": F.get(f"_s{j}", fold) for j in range(len(settings))}, F.get("_seen", fold) > 0)
    joined = counted.select(ident, "class", "fold").join(sums, ident, "left")
    results = F.array(*[
        F.struct(F.lit(c).alias("classifier"), F.lit(float(v)).alias("value"),
                 (F.get(F.array(*[F.lit(b) for b in bias[j * k : (j + 1) * k]]), fold) + F.coalesce(f"_m{j}", F.lit(0.0))).alias("score"))
        for j, (c, v) in enumerate(settings)])
    return joined.withColumn("_r", F.explode_outer(results)).select(
        "_r.classifier", "_r.value", ident, "class", "fold", "_r.score", decided(F.col("_r.score")).alias("prediction"))


def _cross_scored(postings: spans.Postings, sums: np.ndarray, ident: str, settings: Sequence[tuple[str, float]], k: int) -> DataFrame:
    """The out-of-fold rows of models that are sums of passages."""
    bias, scores = sums.sum(axis=0), postings.products(sums)
    # Weights are over the length of all terms; a score is over that of the terms that the model's passages have.
    length = np.sqrt(postings.known())
    length[length == 0] = 1.0
    own = np.arange(len(settings))[None] * k + np.clip(postings.fold, 0, k - 1)[:, None]
    scores = bias[own] + (np.take_along_axis(scores, own, 1) - bias[own]) / length[:, None]
    sent = postings.rows.sparkSession.sparkContext.broadcast(scores)

    def attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value[batch.column("at").to_numpy()]
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, found.ravel())], names=[*batch.schema.names, "_scores"])

    rows = postings.rows.select(ident, "class", "fold", "at")
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    results = F.array(*[F.struct(F.lit(c).alias("classifier"), F.lit(float(v)).alias("value"), F.get("_scores", F.lit(j)).alias("score"))
                        for j, (c, v) in enumerate(settings)])
    return rows.mapInArrow(attached, f"{kinds}, _scores array<double>").withColumn("_r", F.explode_outer(results)).select(
        "_r.classifier", "_r.value", ident, "class", "fold", "_r.score", decided(F.col("_r.score")).alias("prediction"))
