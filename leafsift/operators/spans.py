"""Linear models as sums of their passages, for as many passages as the driver can hold some vectors of.

The minimum of a loss with an L2 penalty is a weighted sum of the passages, so
a model is one number for each passage, whatever the number of terms. The
passages' terms stay tables, dealt out by term (``Postings``); a round
multiplies them with one vector for each model and back, which is one job.

A round adds a model's gradient to the directions found before and minimises
over all of them at once (``Span``), by Newton steps on the driver: the scores
along each direction are known, so this needs no job. The rounds end by the
gradient's length, as those over tables do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.operators.features import term_weights
from leafsift.session import materialise

# Numbers that the driver holds for the directions of one model, or of the models of a group; directions of a model.
# Of few passages all directions are held.
HELD, GROUP_HELD, FEWEST, MOST, FEW = 1 << 25, 1 << 23, 8, 40, 128
# Occurrences of terms in a part, numbers of a block of sums.
PART, BLOCK = 1 << 19, 1 << 18
# Passages whose curvatures are summed at once.
STRIP = 1 << 15

PARTS = "part int, terms array<string>, counts binary, at binary, w binary, at1 binary, w1 binary"


def fits(passages: int) -> bool:
    """Whether the driver can hold the directions of a model of so many passages."""
    return 0 < 2 * FEWEST * passages <= HELD


def _part(table: pa.Table) -> pa.Table:
    """The occurrences of a part's terms as arrays: terms of several passages first, then those of one."""
    names = table["term"].combine_chunks().dictionary_encode()
    code, at, w = names.indices.to_numpy(), table["at"].to_numpy(), table["w"].to_numpy()
    counts = np.bincount(code, minlength=len(names.dictionary))
    terms = np.argsort(counts == 1, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[terms] = np.arange(len(terms))
    order = np.lexsort((at, place[code]))
    at, w, counts = at[order].astype(np.int32), w[order], counts[terms].astype(np.int32)
    shared = int(counts[counts > 1].sum())
    return pa.table({
        "part": pa.array([table["part"][0].as_py()], pa.int32()), "terms": pa.array([names.dictionary.take(pa.array(terms)).to_pylist()], pa.list_(pa.string())),
        **{name: pa.array([v.tobytes()], pa.binary()) for name, v in (
            ("counts", counts), ("at", at[:shared]), ("w", w[:shared]), ("at1", at[shared:]), ("w1", w[shared:]))}})


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    kind = {"counts": np.int32, "at": np.int32, "at1": np.int32}.get(name, np.float64)
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


class Postings:
    """Weights of terms in passages, each term's in one part; passages have numbers from 0 on."""

    def __init__(self, counted: DataFrame):
        """Of ``class, fold, terms``; other columns stay in ``rows``, beside the passage's number ``at``."""
        spark = counted.sparkSession
        rows = materialise(counted.withColumn("_row", F.monotonically_increasing_id()), needed=True)
        found = rows.groupBy(F.shiftright("_row", 33).alias("of")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("entries")).orderBy("of").collect()
        ends = np.cumsum([r["rows"] for r in found]).tolist()
        first = F.create_map(*[F.lit(x) for r, end in zip(found, ends) for x in (r["of"], end - r["rows"])])
        number = F.element_at(first, F.shiftright("_row", 33)) + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
        self.rows = rows.withColumn("at", number.cast("int")).drop("_row")
        self.n = ends[-1] if ends else 0
        listed = self.rows.select("at", F.when(F.col("class") == 1, 1.0).otherwise(-1.0).alias("y"), F.coalesce(F.col("fold").cast("int"), F.lit(-1)).alias("fold")).toArrow()
        order = np.argsort(listed["at"].to_numpy())
        self.y, self.fold = listed["y"].to_numpy()[order], listed["fold"].to_numpy()[order]
        parts = max(spark.sparkContext.defaultParallelism, sum(r["entries"] or 0 for r in found) // PART)
        entries = term_weights(self.rows.select("at", "terms")).select("term", "at", "w").withColumn(
            "part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        self.parts = materialise(entries.repartition(parts, "part").groupBy("part").applyInArrow(_part, PARTS), needed=True)
        n = self.n

        def squares(batch: pa.RecordBatch, row: int) -> np.ndarray:
            return np.bincount(_array(batch, "at1", row), _array(batch, "w1", row) ** 2, n)[:, None]

        # A term of one passage adds to this passage's product with itself alone.
        self.alone = self._summed(squares, ["at1", "w1"], 1)

    def _summed(self, of: Callable[[pa.RecordBatch, int], np.ndarray], columns: Sequence[str], width: int) -> np.ndarray:
        """The sum over all parts of an array of ``width`` numbers for each passage."""
        shape, size = (self.n, width), self.n * width
        blocks = max(1, -(-size // BLOCK))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for row in range(batch.num_rows):
                    total += of(batch, row)
            flat = total.ravel()
            for b in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([flat[b * BLOCK : (b + 1) * BLOCK].tobytes()], pa.binary())], names=["block", "v"])

        def added(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer()) for v in table["v"])
            return pa.table({"block": table["block"][:1], "v": pa.array([total.tobytes()], pa.binary())})

        found = self.parts.select(*columns).mapInArrow(sums, "block long, v binary")
        if blocks > 1:
            found = found.groupBy("block").applyInArrow(added, "block long, v binary")
        out = np.zeros(size)
        for r in found.collect():
            out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["v"])
        return out.reshape(shape)

    def products(self, vectors: np.ndarray) -> np.ndarray:
        """All passages' inner products with sums of passages (with the constant term); a column of ``vectors`` is a sum's weights."""
        n, sent = self.n, self.parts.sparkSession.sparkContext.broadcast(vectors)

        def multiplied(batch: pa.RecordBatch, row: int) -> np.ndarray:
            vectors, at, w = sent.value, _array(batch, "at", row), _array(batch, "w", row)
            counts = _array(batch, "counts", row)
            counts = counts[counts > 1]
            out = np.zeros((n, vectors.shape[1]))
            if len(counts):
                starts = np.cumsum(counts) - counts
                for k in range(vectors.shape[1]):
                    sums = np.add.reduceat(w * vectors[at, k], starts)
                    out[:, k] = np.bincount(at, w * np.repeat(sums, counts), n)
            return out

        out = self._summed(multiplied, ["counts", "at", "w"], vectors.shape[1])
        sent.destroy()
        return out + self.alone * vectors + vectors.sum(axis=0)

    def known(self) -> np.ndarray:
        """Sum of the squared weights of a passage's terms that passages of other folds have as well."""
        n, sent = self.n, self.parts.sparkSession.sparkContext.broadcast(self.fold)

        def squares(batch: pa.RecordBatch, row: int) -> np.ndarray:
            at, w, counts = _array(batch, "at", row), _array(batch, "w", row), _array(batch, "counts", row)
            counts = counts[counts > 1]
            owner, fold = np.repeat(np.arange(len(counts)), counts), sent.value[at].astype(np.int64)
            low, high = (fold.min(), fold.max()) if len(fold) else (0, 0)
            key = owner * (high - low + 1) + fold - low
            own = np.bincount(key, minlength=len(counts) * (high - low + 1))[key]
            return np.bincount(at, w * w * (own < counts[owner]), n)[:, None]

        out = self._summed(squares, ["counts", "at", "w"], 1)[:, 0]
        sent.destroy()
        return out

    def terms(self, vectors: np.ndarray) -> DataFrame:
        """``term, t0, t1, ...``: the sums of passages, term by term."""
        names, sent = [f"t{k}" for k in range(vectors.shape[1])], self.parts.sparkSession.sparkContext.broadcast(vectors)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    at, w, counts, at1, w1 = (_array(batch, c, row) for c in ("at", "w", "counts", "at1", "w1"))
                    shared = counts[counts > 1]
                    starts = np.cumsum(shared) - shared
                    found = [np.concatenate([np.add.reduceat(w * v[at], starts) if len(shared) else np.zeros(0), w1 * v[at1]]) for v in sent.value.T]
                    terms = batch.column("terms")[row].values
                    for a in range(0, len(terms), STRIP):
                        yield pa.RecordBatch.from_arrays([terms[a : a + STRIP], *[pa.array(v[a : a + STRIP]) for v in found]], names=["term", *names])

        return materialise(self.parts.mapInArrow(rows, ", ".join(["term string", *[f"{c} double" for c in names]])), needed=True)


class Span:
    """A model as the sum of directions ``q``, each a sum of passages, with the passages' scores ``z``.

    Directions have length one and are at right angles, so the penalty is that of their weights ``c``.
    """

    def __init__(self, setting, own: np.ndarray, y: np.ndarray, penalty: float, rows: int, most: int, goal: float):
        self.setting, self.own, self.y, self.penalty, self.rows, self.goal = setting, own, y[own], penalty, rows, goal
        self.q, self.z, self.c = np.empty((most, len(own))), np.empty((most, len(own))), np.zeros(0)

    @property
    def weights(self) -> np.ndarray:
        """The model as one number for each own passage."""
        return self.c @ self.q[: len(self.c)]

    def _margins(self, c: np.ndarray) -> np.ndarray:
        return self.y * (c @ self.z[: len(c)])

    def gradient(self) -> np.ndarray:
        return self.penalty * self.weights - self.y * self.setting.local(self._margins(self.c))[1] / self.rows

    def add(self, v: np.ndarray, kv: np.ndarray, length: float) -> None:
        """One more direction, ``v`` with the scores ``kv``, as far as it leads away from the others."""
        if len(self.c) == len(self.q):
            self._shorten()
        k = len(self.c)
        v, kv = v / length, kv / length
        for _ in range(2):
            along = self.z[:k] @ v
            v, kv = v - along @ self.q[:k], kv - along @ self.z[:k]
        left = float(v @ kv)
        if left > 1e-12:
            self.q[k], self.z[k], self.c = v / np.sqrt(left), kv / np.sqrt(left), np.append(self.c, 0.0)

    def _shorten(self) -> None:
        """The model itself and the newest half of the directions stay."""
        size = len(self.c)
        turn = np.linalg.qr(np.column_stack([self.c, np.eye(size)[:, size - size // 2 :]]))[0]
        for a in range(0, len(self.own), STRIP):
            for held in (self.q, self.z):
                held[: turn.shape[1], a : a + STRIP] = turn.T @ held[:, a : a + STRIP]
        self.c = turn.T @ self.c

    def settle(self) -> None:
        """The minimum over the directions, by Newton steps that are halved until the loss falls."""
        k = len(self.c)
        loss, pull, curvature = self.setting.local(self._margins(self.c))
        here = 0.5 * self.penalty * self.c @ self.c + loss / self.rows
        for _ in range(100):
            slope = self.penalty * self.c - self.z[:k] @ (self.y * pull) / self.rows
            if np.linalg.norm(slope) <= 0.01 * self.goal:
                break
            bend = self.penalty * np.eye(k)
            for a in range(0, len(self.y), STRIP):
                bent = np.flatnonzero(curvature[a : a + STRIP])
                z = self.z[:k, a : a + STRIP][:, bent]
                bend += (z * curvature[a : a + STRIP][bent]) @ z.T / self.rows
            step, size = -np.linalg.solve(bend, slope), 1.0
            fall = float(slope @ step)
            while True:
                c = self.c + size * step
                loss, pull, curvature = self.setting.local(self._margins(c))
                there = 0.5 * self.penalty * c @ c + loss / self.rows
                if there <= here + 1e-4 * size * fall + 1e-15 or size < 1e-9:
                    break
                size /= 2
            if size < 1e-9:
                break
            self.c, here = c, there


def minimised(
    postings: Postings, settings: Sequence, penalty: Sequence[float], rows: Sequence[int], goals: Sequence[float], most_rounds: int
) -> np.ndarray:
    """For all settings the models' weights of passages, ``(passages, settings)``.

    Models whose directions the driver cannot hold together are found in groups, from the strongest penalty on.
    """
    n = postings.n
    weights = np.zeros((n, len(settings)))
    wanted = max(MOST, min(FEW, GROUP_HELD // (2 * n * len(settings))))
    group = max(1, min(len(settings), GROUP_HELD // (2 * wanted * n)))
    most = max(FEWEST, min(wanted, (HELD if len(settings) == 1 else GROUP_HELD) // (2 * n)))
    order = sorted(range(len(settings)), key=lambda i: -penalty[i])
    for a in range(0, len(order), group):
        active = {i: Span(settings[i], np.arange(n) if settings[i].fold is None else np.flatnonzero(postings.fold != settings[i].fold),
                          postings.y, penalty[i], rows[i], most, goals[i]) for i in order[a : a + group]}
        for _ in range(most_rounds):
            vectors = np.zeros((n, len(active)), order="F")
            for k, span in enumerate(active.values()):
                vectors[span.own, k] = span.gradient()
            found, ended = postings.products(vectors), []
            for k, (i, span) in enumerate(active.items()):
                v, kv = vectors[span.own, k], found[span.own, k]
                length = np.sqrt(max(float(v @ kv), 0.0))
                if length <= goals[i]:
                    ended.append(i)
                else:
                    span.add(v, kv, length)
                    span.settle()
            for i in ended:
                span = active.pop(i)
                weights[span.own, i] = span.weights
            if not active:
                break
        else:
            raise RuntimeError(f"no convergence in {most_rounds} rounds; the tolerance may be too small")
    return weights
