"""Exact top-k inner products with multi-resolution segment bounds.

A vector is cut into 1, 2, 4, ... segments; of each segment its mean and its
deviation are kept. For a query q and a candidate x the sum over segments of
``n * (mean_q * mean_x + dev_q * dev_x)`` is never below the inner product
(with the norms, it bounds the distance from below), and halving the segments
tightens it. Candidates are tested coarse to fine against the k-th best score
known so far; only survivors are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: every component as floor(scale * x); vectors that are null or hold null, NaN or infinite components are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (only(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
            .select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v")))


def levels_of(width: int) -> list[int]:
    """Numbers of segments, coarse to fine, up to about a quarter of the width."""
    return [s for s in (1, 2, 4, 8, 16, 32, 64) if s == 1 or s * 4 <= width]


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that their inner product is the bound."""
    parts = [p for p in np.array_split(np.arange(x.shape[1]), segments) if len(p)]
    out = np.zeros((len(x), 2 * segments))
    for i, part in enumerate(parts):
        block = x[:, part]
        mean = block.mean(axis=1)
        out[:, 2 * i] = mean * np.sqrt(len(part))
        out[:, 2 * i + 1] = np.sqrt(np.maximum(((block - mean[:, None]) ** 2).sum(axis=1), 0))
    return out


class Query:
    """A block of queries of one width with their statistics and the best scores so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.levels = [(s, segment_statistics(v.astype(float), s)) for s in levels_of(v.shape[1])]
        self.norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        self.floor = floor.astype(float)  # a score that k candidates of others are known to reach
        self.best: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(ids)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in a block of candidates."""
        xf = x.astype(float)
        slack = 1e-9 * self.norm.max(initial=0) * np.sqrt((xf**2).sum(axis=1)).max(initial=0) + 0.5
        alive = None
        for segments, own in self.levels:
            other = segment_statistics(xf, segments)
            if alive is None:
                q, c = np.nonzero(own @ other.T + slack >= self.floor[:, None])
            else:
                q, c = alive
                keep = np.concatenate([np.einsum("ij,ij->i", own[q[i : i + 65536]], other[c[i : i + 65536]]) + slack
                                       >= self.floor[q[i : i + 65536]] for i in range(0, len(q), 65536)] or [np.empty(0, bool)])
                q, c = q[keep], c[keep]
            alive = q, c
        q, c = alive
        score = np.concatenate([(self.v[q[i : i + 65536]] * x[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]
                               or [np.empty(0, np.int64)])
        own = ids[c] != self.ids[q]
        q, c, score = q[own], c[own], score[own]
        for at, lo, hi in zip(*_runs(q)):
            both = np.concatenate([self.best[at], np.column_stack([-score[lo:hi], ids[c[lo:hi]]])])
            both = both[np.lexsort((both[:, 1], both[:, 0]))][: self.k]
            self.best[at] = both
            if len(both) == self.k:
                self.floor[at] = max(self.floor[at], -both[-1, 0])

    def rows(self) -> Iterator[pd.DataFrame]:
        for ident, best in zip(self.ids, self.best):
            if len(best):
                yield pd.DataFrame({"query_id": ident, "vec_id": best[:, 1], "score": -best[:, 0]})


def _runs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(q, return_index=True)
    return values, first, np.append(first[1:], len(q))


def _arrays(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix for each width of vector."""
    for _, same in rows.groupby(rows["v"].map(len), sort=True):
        yield same["vec_id"].to_numpy(np.int64), np.array(same["v"].tolist(), np.int64).reshape(len(same), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 1024, queries_per_pass: int = 1 << 15,
          start: int = 2048) -> DataFrame:
    """The ``k`` best candidates of every query row, by integer inner product, ties to the smaller id.

    Candidates are all rows but those with the query's own id. Returns
    ``query_id, rank, vec_id, score``. Queries go round in passes of at most
    ``queries_per_pass`` (a bound on what is broadcast), each over all
    candidates. ``start`` candidates first give every query a score to beat;
    they are found exactly like all others, so the result does not depend on
    it.

    Vectors that are null, or hold null or non-finite components, and null ids
    take no part; vectors of different width do not meet; repeated rows count
    as candidates of their own; empty tables give no rows. Products must fit
    into 64 bits.
    """
    spark = vectors.sparkSession
    rows = staged(whole_numbers(vectors, scale), "vectors")
    asked = staged(rows.filter(is_query).withColumn("_h", F.xxhash64("vec_id", "v")), "vector-queries")
    passes = max(1, -(-asked.count() // queries_per_pass))
    first = rows.orderBy(F.xxhash64("vec_id")).limit(start).toPandas()
    out = None
    for number in range(passes):
        mine = asked.filter(F.pmod("_h", F.lit(passes)) == number).drop("_h").dropDuplicates().toPandas()
        groups = []
        for ids, v in _arrays(mine):
            query = Query(ids, v, np.full(len(ids), -np.inf), k)
            for c_ids, x in _arrays(first):
                if x.shape[1] == v.shape[1]:
                    for i in range(0, len(x), block):
                        query.offer(c_ids[i : i + block], x[i : i + block])
            groups.append((ids, v, query.floor))
        sent = spark.sparkContext.broadcast(groups)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            blocks = [Query(ids[i : i + 512], v[i : i + 512], floor[i : i + 512], k)
                      for ids, v, floor in sent.value for i in range(0, len(ids), 512)]
            for batch in batches:
                for ids, x in _arrays(batch):
                    for query in blocks:
                        if query.v.shape[1] == x.shape[1]:
                            for i in range(0, len(x), block):
                                query.offer(ids[i : i + block], x[i : i + block])
            for query in blocks:
                yield from query.rows()

        part = rows.mapInPandas(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
