"""Ranked lexical search with the Best Position Algorithm.

A block of documents holds, for every term asked for, a list of its documents
by falling impact. For an item all its lists are read in parallel from the
top; a document met in one list is looked up in all others at once, which
gives its score and its places there. The best position of a list is the last
one up to which every place has been seen, in whichever way; what lies below
all best positions cannot score more than the sum of the impacts there, and
reading stops once that sum is strictly below the k-th best score.

Blocks are independent: a task carries the k best of every item from block to
block, so later blocks stop sooner, and the best of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

#: A-Z to a-z; digits, a-z and the bytes of all characters beyond ASCII stay; all else parts terms.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text read at once, distinct terms asked for in one pass, and postings of a block.
PART, PASS_TERMS, BLOCK = 1 << 20, 100_000, 1 << 20
#: Places of every list read in the first round of an item; later rounds read twice as many as the one before.
DEPTH = 32
#: The scale of weights and impacts, and of the part that a document's length plays.
WEIGHT, IMPACT, LEVEL, SLOPE, LENGTH = 1000, 1_000_000_000, 100, 25, 12

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in runs of about ``PART`` bytes, so that a very long text needs no more memory."""
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):
            # A term is not cut: the run goes on to the next byte that parts terms.
            while end < len(raw) and TERM_BYTES[raw[end]] != 32:
                end += 1
        yield raw[at:end].translate(TERM_BYTES).split()
        at = end


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds per unit of weight in a document of ``n`` terms."""
    m = LEVEL - SLOPE + (SLOPE * n * documents) // length
    return (IMPACT * tf) // (WEIGHT * tf + LENGTH * m)


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Item:
    """Numbers of an item's distinct terms and their weights times their repeats."""

    key: int
    terms: np.ndarray
    weights: np.ndarray


class Lists:
    """The impact lists of a block of documents: ``doc`` counts the block's documents, ``starts`` bounds their postings."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.starts, self.terms, self.impacts = ids, starts, terms, impacts
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        # Postings by term and falling impact; where each posting stands in its term's list.
        self.order = np.lexsort((doc, -impacts, terms))
        self.doc = doc[self.order]
        self.first = np.searchsorted(terms[self.order], np.arange(n_terms + 1))
        self.place = np.empty(len(terms), np.int64)
        self.place[self.order] = np.arange(len(terms)) - self.first[terms[self.order]]

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all postings of the documents, and which of the documents each belongs to."""
        count = self.starts[docs + 1] - self.starts[docs]
        owner = np.repeat(np.arange(len(docs)), count)
        return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + self.starts[docs][owner], owner


class Best:
    """The best documents of an item so far, and the score to beat."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.ids, self.scores, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores > 0) & (scores >= self.least)
        ids, nulls, scores = (np.append(a, b[keep]) for a, b in ((self.ids, ids), (self.nulls, nulls), (self.scores, scores)))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.ids, self.nulls, self.scores = ids[order], nulls[order], scores[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def best_positions(lists: Lists, item: Item, weights: np.ndarray, slot: np.ndarray, best: Best, nulls: np.ndarray) -> int:
    """Take the block's documents into ``best``; returns the number of documents looked up.

    ``weights`` and ``slot`` are scratch arrays over all terms: the item's
    weight of a term, zero elsewhere, and the number of its list.
    """
    length = lists.first[item.terms + 1] - lists.first[item.terms]
    used = np.flatnonzero((length > 0) & (item.weights > 0))
    if not len(used):
        return 0
    terms, begin, length = item.terms[used], lists.first[item.terms[used]], length[used]
    weights[terms], slot[terms] = item.weights[used], np.arange(len(terms))
    seen = np.zeros(int(length.sum()), bool)
    offset = np.cumsum(length) - length
    known = np.zeros(len(lists.ids), bool)
    bp, depth, step, looked = np.zeros(len(terms), np.int64), 0, DEPTH, 0
    while True:
        # Sorted access: the next places of all lists.
        upto = min(depth + step, int(length.max()))
        met = np.concatenate([lists.doc[b + depth : b + min(upto, n)] for b, n in zip(begin, length) if n > depth])
        met = np.unique(met)
        met = met[~known[met]]
        known[met] = True
        looked += len(met)
        # Direct access: scores and places of the documents in all lists.
        at, owner = lists.postings(met)
        own = weights[lists.terms[at]] > 0
        at, owner = at[own], owner[own]
        term = lists.terms[at]
        scores = np.zeros(len(met), np.int64)
        np.add.at(scores, owner, weights[term] * lists.impacts[at])
        seen[offset[slot[term]] + lists.place[at]] = True
        best.add(lists.ids[met], nulls[met], scores)
        depth, step = upto, 2 * step
        # Best positions, and the most that a document not seen can score.
        bound = 0
        for i, (b, n, o) in enumerate(zip(begin, length, offset)):
            rest = seen[o + bp[i] : o + n]
            if rest.all():
                bp[i] = n
                continue
            bp[i] += int(rest.argmin())
            # The first place not seen has no more than the impact at the best position, and is what may come next.
            bound += int(weights[terms[i]]) * int(lists.impacts[lists.order[b + max(bp[i] - 1, 0)]])
        if bound < max(best.least, 1) and (len(best.ids) == best.k or bound == 0) or depth >= int(length.max()):
            break
    weights[terms] = 0
    return looked


def _read(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Forward postings: of each document its number of terms, and how often each term asked for occurs."""
    known = vocabulary.value
    for batch in batches:
        ns, terms, tfs, ends = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            n, found = 0, Counter()
            for run in terms_of(text):
                n += len(run)
                found.update(map(known.get, run))
            found.pop(None, None)
            ns.append(n)
            for t in sorted(found):
                terms.append(t)
                tfs.append(found[t])
            ends.append(len(terms))
        offsets = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])


def _search(sent, k: int, documents: int, length: int, most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_terms = sent.value
        weights, slot = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        best = [Best(k) for _ in items]

        def read(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, n, terms, tfs = (c.chunk(0) for c in table.columns)
            nulls = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            counts = np.diff(terms.offsets.to_numpy())
            tf = tfs.flatten().to_numpy(zero_copy_only=False)
            n = np.repeat(n.to_numpy(zero_copy_only=False), counts)
            lists = Lists(ids, np.append(0, np.cumsum(counts)), terms.flatten().to_numpy(zero_copy_only=False),
                          impact(tf, n, documents, length), n_terms)
            for item, b in zip(items, best):
                best_positions(lists, item, weights, slot, b, nulls)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= most:
                read(held)
                held, size = [], 0
        if held:
            read(held)
        for item, b in zip(items, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.ids), item.key)), pa.array(b.ids, mask=b.nulls), pa.array(b.scores)], names=["key", "doc_id", "score"])

    return search


def _passes(items: Iterator[tuple[int, Counter]]) -> Iterator[list[tuple[int, Counter]]]:
    """Items that together stay near ``PASS_TERMS`` distinct terms and ten times as many weights."""
    held, terms, weights = [], set(), 0
    for key, found in items:
        if held and (len(terms) + len(found) > PASS_TERMS or weights + len(found) > 10 * PASS_TERMS):
            yield held
            held, terms, weights = [], set(), 0
        held.append((key, found))
        terms |= found.keys()
        weights += len(found)
    if held:
        yield held


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents above 0 of every item, equal scores by ascending id.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``. An
    item's repeated terms count each time. Items go round in passes of about
    ``PASS_TERMS`` distinct terms (a bound on what is broadcast), one reading
    of the texts each. A task takes documents in blocks of about ``block``
    postings.

    Null and empty texts have no terms: such documents count nowhere, such
    items rank nothing. Very long texts are read part by part. Documents that
    share an id, or are repeated, rank as documents of their own, next to each
    other at equal scores; null ids come last among equals. Items with equal id and text are one item; items
    that share an id alone are ranked apart. Empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = staged(only(items, "item_id", "text").dropDuplicates().withColumn("_key", F.monotonically_increasing_id()), "items")
    out = None
    for held in _passes(_read_items(asked)):
        numbers = {t: i for i, t in enumerate(sorted({t for _, found in held for t in found}))}
        vocabulary = spark.sparkContext.broadcast(numbers)
        forward = staged(docs.mapInArrow(lambda b, v=vocabulary: _read(b, v), POSTINGS), "postings")
        totals = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not totals.documents:
            continue
        df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas().itertuples(index=False))
        sent = spark.sparkContext.broadcast(([Item(
            key, np.array([numbers[t] for t in found], np.int64),
            np.array([c * weight(totals.documents, df.get(numbers[t], 0)) for t, c in found.items()], np.int64)) for key, found in held], len(numbers)))
        found = forward.mapInArrow(_search(sent, k, totals.documents, totals.length, block), "key long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "key long, doc_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("_key").alias("key"), "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def _read_items(asked: DataFrame) -> Iterator[tuple[int, Counter]]:
    """Keys and term counts, item after item: the driver holds the items of one pass."""
    for row in asked.select("_key", "text").orderBy("_key").toLocalIterator():
        found = Counter()
        for run in terms_of(row.text):
            found.update(run)
        if found:
            yield row["_key"], found
