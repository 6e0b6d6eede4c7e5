"""Hard negatives by exact scores from a residue number system.

An integer inner product is computed as several products of matrices of small
residues, one per prime, in 32-bit floating point, where every sum is exact;
the Chinese remainder theorem gives the signed score back. Per anchor the best
rows of its own label are its positives; every positive opens a window of
scores, and the best rows of other labels inside it are the hard negatives.

Anchors go round in blocks of a bounded size, each against all rows; tasks
keep the best few of every anchor and pass nothing else on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

#: Whole numbers up to here are exact in 32-bit floating point.
EXACT = 1 << 24
#: Components multiplied before the sums are reduced again.
STRIP = 4096
#: Scores must stay below, so that a hundred times a score fits into 64 bits.
LARGEST = 1 << 55


def whole_rows(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """``vec_id, label, v``: components as floor(scale * x), without the rows that take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = only(vectors, "vec_id", "embedding", "label")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def primes_below(top: int) -> Iterator[int]:
    """Odd primes below ``top``, largest first."""
    for n in range(top - 1, 2, -1):
        if n % 2 and all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            yield n


def moduli(width: int, bound: int) -> list[int]:
    """Primes whose residues multiply exactly over ``width`` components and whose product covers -bound..bound."""
    strip = min(width, STRIP)
    # A residue lies within (p - 1) / 2 of zero, so a sum of products within strip * ((p - 1) / 2) ** 2.
    top = int(2 * ((EXACT - 1) / strip) ** 0.5)
    chosen, product = [], 1
    for p in primes_below(top):
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound or bound >= LARGEST:
        raise ValueError(f"scores up to {bound} do not fit")
    return chosen


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2."""
    half = p // 2
    return (x + half) % p - half


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` for matrices of centred residues in float32, strip by strip."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(0, a.shape[1], STRIP):
        out += (a[:, i : i + STRIP] @ b[:, i : i + STRIP].T).astype(np.int64)
        out %= p
    return out


def signed_scores(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers nearest to zero with the given residues: mixed-radix digits, then the upper half made negative."""
    value, product = residues[0].copy(), primes[0]
    for residue, p in zip(residues[1:], primes[1:]):
        digit = (residue - value) % p * pow(product, -1, p) % p
        value += digit * product
        product *= p
    value[value > product // 2] -= product
    return value


class Anchors:
    """A block of anchors of one width; multiplies candidates exactly."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.keys, self.ids, self.labels, self.v = keys, ids, labels, v
        self.most = int(np.abs(v).max(initial=0))
        self.residues: dict[int, np.ndarray] = {}

    def of(self, p: int) -> np.ndarray:
        if p not in self.residues:
            self.residues[p] = centred(self.v, p).astype(np.float32)
        return self.residues[p]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One row per anchor, one column per candidate."""
        width = self.v.shape[1]
        bound = width * self.most * int(np.abs(x).max(initial=0))
        if not bound:
            return np.zeros((len(self.v), len(x)), np.int64)
        primes = moduli(width, bound)
        return signed_scores([residue_product(self.of(p), centred(x, p).astype(np.float32), p) for p in primes], primes)


@dataclass
class Best:
    """The best ``k`` of each slot by score, ties to the smaller id."""

    slots: int
    k: int

    def __post_init__(self):
        self.slot = np.empty(0, np.int64)
        self.ids, self.score = self.slot, self.slot
        self.least = np.full(self.slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = np.append(self.slot, slot), np.append(self.ids, ids), np.append(self.score, score)
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.r_[True, slot[1:] != slot[:-1]]
        nth = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = nth < self.k
        self.slot, self.ids, self.score = slot[keep], ids[keep], score[keep]
        full = nth[keep] == self.k - 1
        self.least[self.slot[full]] = self.score[full]


def _matrices(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and matrix for each width of vector."""
    for _, same in rows.groupby(rows["v"].map(len), sort=True):
        yield (same["vec_id"].to_numpy(np.int64), same["label"].to_numpy(np.int64),
               np.array(same["v"].tolist(), np.int64).reshape(len(same), -1))


def _blocks(anchors: pd.DataFrame, size: int = 512) -> Iterator[tuple[Anchors, pd.DataFrame]]:
    for _, same in anchors.groupby(anchors["v"].map(len), sort=True):
        for i in range(0, len(same), size):
            part = same.iloc[i : i + size]
            v = np.array(part["v"].tolist(), np.int64).reshape(len(part), -1)
            yield Anchors(*(part[c].to_numpy(np.int64) for c in ("anchor", "vec_id", "label")), v), part


def _candidates(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, labels, x in _matrices(batch):
            for i in range(0, len(x), size):
                yield ids[i : i + size], labels[i : i + size], x[i : i + size]


def _positives(sent, k: int, size: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [(a, Best(len(a.ids), k)) for a, _ in _blocks(sent.value)]
        for ids, labels, x in _candidates(batches, size):
            for a, best in blocks:
                if a.v.shape[1] != x.shape[1]:
                    continue
                score = a.scores(x)
                fit = (a.labels[:, None] == labels) & (a.ids[:, None] != ids) & (score >= best.least[:, None])
                at, c = np.nonzero(fit)
                best.add(at, ids[c], score[at, c])
        for a, best in blocks:
            if len(best.slot):
                yield pd.DataFrame({"anchor": a.keys[best.slot], "found": best.ids, "score": best.score})

    return search


def _negatives(sent, k: int, size: int, low: int, high: int):
    """``low`` and ``high``: hundredths of the positive's score that bound the window."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = []
        for a, part in _blocks(sent.value):
            scores = part["positive_scores"].tolist()
            width = max(map(len, scores), default=0)
            of = np.zeros((len(scores), width), np.int64)
            has = np.zeros((len(scores), width), bool)
            for i, s in enumerate(scores):
                of[i, : len(s)], has[i, : len(s)] = s, True
            blocks.append((a, of, has, Best(len(scores) * width, k)))
        for ids, labels, x in _candidates(batches, size):
            for a, of, has, best in blocks:
                if a.v.shape[1] != x.shape[1]:
                    continue
                hundred = 100 * a.scores(x)
                other = a.labels[:, None] != labels
                width = of.shape[1]
                for j in range(width):
                    least = np.maximum(best.least[j::width], -LARGEST)
                    fit = (other & has[:, j, None] & (hundred >= low * of[:, j, None]) & (hundred <= high * of[:, j, None])
                           & (hundred >= 100 * least[:, None]))
                    at, c = np.nonzero(fit)
                    best.add(at * width + j, ids[c], hundred[at, c] // 100)
        for a, of, _, best in blocks:
            if len(best.slot):
                at, j = np.divmod(best.slot, of.shape[1])
                yield pd.DataFrame({"anchor": a.keys[at], "place": j, "found": best.ids, "score": best.score})

    return search


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = 256, anchors_per_pass: int = 1 << 15, block: int = 1024) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` may restate the label (a column expression of the table). An
    anchor's positives are its best ``positives`` rows of the same label, a
    positive's negatives the best ``negatives`` rows of other labels whose
    score lies from ``low`` to ``high`` hundredths of the positive's; equal
    scores go by ascending id. No row scores against its own id.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; vectors of different width do not meet; repeated rows count
    as rows of their own among candidates and once as an anchor; two anchors
    that share an id are mined apart; anchors without positives, and windows
    without rows, give no rows. A negative positive score opens no window.
    At most ``anchors_per_pass`` anchors are broadcast at a time, with at most
    ``positives`` scores each. Vectors whose products may reach 2**55 raise an error.
    """
    spark = vectors.sparkSession
    rows = staged(whole_rows(vectors, F.col("label") if label is None else label, scale), "mined")
    asked = rows.filter(F.coalesce(is_anchor, F.lit(False))).dropDuplicates()
    # The numbers are written, so they hold if a task is repeated.
    asked = staged(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    passes = max(1, -(-asked.count() // anchors_per_pass))
    out = None
    for number in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("anchor"), F.lit(passes)) == number)
        local = mine.toPandas()
        sent = spark.sparkContext.broadcast(local)
        best = Window.partitionBy("anchor").orderBy(F.desc("score"), "found")
        chosen = rows.mapInPandas(_positives(sent, positives, block), "anchor long, found long, score long")
        chosen = staged(chosen.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives), "positives")
        scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("s")).select(
            "anchor", F.col("s.score").alias("positive_scores")).toPandas()
        opened = spark.sparkContext.broadcast(local.merge(scores, on="anchor"))
        best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found")
        window = rows.mapInPandas(_negatives(opened, negatives, block, low, high), "anchor long, place int, found long, score long")
        window = window.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
        part = window.select("anchor", "place", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")).join(
            chosen.select("anchor", "place", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"]
        ).join(mine.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        out = part if out is None else out.unionByName(part)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
