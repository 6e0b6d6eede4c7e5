"""Benchmark decontamination with suffix arrays of the training shards.

Every task sorts the suffixes of its share of the documents (its shard) by
words, and looks up every suffix of the benchmark by binary search, all at
once. The places found put the suffixes of both sides in one order, in which
the neighbours of a document's suffix among those of the benchmark have its
longest verbatim match. The range of suffixes that begin with a window of the
benchmark gives all its occurrences, and these are compared with all places
of the window, since the order goes no deeper than a window.

Words that the benchmark doesn't have end a match, so suffixes that begin
with one are left out before sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

#: A-Z to a-z; digits, a-z and the bytes of all characters beyond ASCII stay; all else parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text per suffix array, and per step of reading a long text.
SHARD, PART = 4 << 20, 1 << 20
#: Words of the benchmark sent to the tasks in one pass over the documents.
PASS_WORDS = 500_000

SCHEMA = ("n_words long | hits array<struct<first:int,last:int>> | items array<string> | longest int | longest_at int | "
          "longest_item string")


@dataclass
class Benchmark:
    """One pass of items: their words as numbers from 1, one item after the other, each ended by 0."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    lengths: np.ndarray  # of each distinct window; where it starts, and the items that have it
    places: list[list[int]]
    items: list[list[str]]
    item_at: list[str]  # the item of each place
    suffixes: np.ndarray  # a place of each suffix (of as many words as a window) in their order; its number of words
    sizes: np.ndarray


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def prepared(items: list[tuple[object, str | None]], window: int) -> Benchmark:
    vocabulary: dict[bytes, int] = {}
    named: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:  # items with the same words are one
        own = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        named.setdefault(own, set()).add("" if item_id is None else str(item_id))
    windows: dict[tuple[int, ...], int] = {}
    words: list[int] = []
    places, owners, item_at = [], [], []
    for own, names in named.items():
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            at = windows.setdefault(own[i : i + size], len(windows))
            if at == len(places):
                places.append([])
                owners.append(set())
            places[at].append(len(words) + i)
            owners[at] |= names
        words += [*own, 0]
        item_at += [min(names)] * (len(own) + 1)
    lengths = np.array([len(w) for w in windows], np.int64)
    y = np.array(words + [0] * (window + 1), np.int32)
    suffixes = suffix_array(y, 1, window, len(vocabulary))
    shared = common_prefix(y, suffixes[:-1], y, suffixes[1:], window)
    left = np.searchsorted(np.flatnonzero(y == 0), suffixes)
    sizes = np.minimum(np.flatnonzero(y == 0)[left] - suffixes, window)
    other = np.append(True, shared < np.maximum(sizes[1:], sizes[:-1]))[: len(suffixes)]  # equal ones are looked up once
    return Benchmark(vocabulary, y, lengths, places, [sorted(o) for o in owners], item_at, suffixes[other], sizes[other])


def numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a whole text, 0 for words that the benchmark lacks; long texts are read part by part."""
    out, at = [], 0
    text = text.translate(WORD_BYTES)
    while at < len(text):
        end = text.find(b" ", at + PART)
        words = text[at : len(text) if end < 0 else end].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = len(text) if end < 0 else end
    return np.concatenate(out) if out else np.empty(0, np.int32)


def suffix_array(x: np.ndarray, least: int, depth: int, words: int) -> np.ndarray:
    """Places of ``x`` whose next ``least`` words are all known, in the order of the next ``depth`` words.

    ``x`` ends with more than ``depth`` zeros; word numbers are at most
    ``words``. What follows a 0 no longer counts.
    """
    zeros = np.concatenate([[0], np.cumsum(x == 0)])
    n = len(x) - depth - 1
    known = np.flatnonzero(zeros[least : least + n] == zeros[:n])
    bits = max(1, words.bit_length())
    keys, alive = [], np.ones(len(known), bool)
    for d in range(depth):
        word = np.where(alive, x[known + d], 0).astype(np.int64)
        alive &= word > 0
        if d % (63 // bits) == 0:  # as many words as fit make one key
            keys.append(word)
        else:
            keys[-1] = keys[-1] << bits | word
    return known[np.lexsort(keys[::-1])]


def common_prefix(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Number of equal known words from places ``a`` of ``x`` and ``b`` of ``y`` on, counted up to ``most``."""
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live) and (most is None or length[live[0]] < most):
        u, v = a[live] + length[live], b[live] + length[live]
        inside = (u < len(x)) & (v < len(y))
        live, u, v = live[inside], u[inside], v[inside]
        live = live[(x[u] == y[v]) & (x[u] > 0)]
        length[live] += 1
    return length


def bounds(x: np.ndarray, order: np.ndarray, y: np.ndarray, queries: np.ndarray, sizes: np.ndarray, right: bool) -> np.ndarray:
    """For suffixes of ``y``, cut to ``sizes`` words, the first place in ``order`` not before (``right``: after) them."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order))
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        place, query, size = order[mid], queries[live], sizes[live]
        before = np.zeros(len(live), bool)
        going = np.arange(len(live))
        d = 0
        while len(going):
            done = size[going] <= d
            before[going[done]] = right  # equal in all words that count
            going = going[~done]
            u, v = x[place[going] + d], y[query[going] + d]
            before[going] = u < v
            going = going[(u == v) & (u > 0)]
            d += 1
        lo[live[before]] = mid[before] + 1
        hi[live[~before]] = mid[~before]


def matched(texts: list[bytes], bench: Benchmark, window: int) -> Iterator[tuple]:
    """For each text: words, hit ranges, items with occurring windows, and the longest match with its place and item."""
    each = [numbers(t, bench.vocabulary) for t in texts]
    sizes = np.array([len(e) for e in each], np.int64)
    # A 0 parts the documents.
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.zeros(int((sizes + 1).sum()) + window + 1, np.int32)
    for s, e in zip(starts, each):
        x[s : s + len(e)] = e
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    longest: list[tuple] = [(0, None, None)] * len(texts)
    if len(bench.lengths):
        order = suffix_array(x, 1, window, len(bench.vocabulary))
        for doc, *best in _longest(x, order, starts, bench, window):
            longest[doc] = tuple(best)
        tests = np.array([p[0] for p in bench.places], np.int64)
        lo = bounds(x, order, bench.words, tests, bench.lengths, False)
        hi = bounds(x, order, bench.words, tests, bench.lengths, True)
        for w in np.flatnonzero(lo < hi):
            places = order[lo[w] : hi[w]]
            docs = np.searchsorted(starts, places, "right") - 1
            inside = (places - starts[docs]).tolist()
            for doc, at in zip(docs.tolist(), inside):
                hits[doc].append((at, at + int(bench.lengths[w]) - 1))
                found[doc].update(bench.items[w])
            for test in bench.places[w]:
                match = common_prefix(x, places, bench.words, np.full(len(places), test))
                for doc, at, size in zip(docs.tolist(), inside, match.tolist()):
                    if (-size, at, bench.item_at[test]) < (-longest[doc][0], *longest[doc][1:]):
                        longest[doc] = (size, at, bench.item_at[test])
    for size, ranges, items, best in zip(sizes.tolist(), hits, found, longest):
        yield size, _joined(ranges), sorted(items), *best


def _longest(x: np.ndarray, order: np.ndarray, starts: np.ndarray, bench: Benchmark, window: int) -> Iterator[tuple[int, int, int, str]]:
    """Document, words (at most a window), place and item of the longest match of each document that has one, the first of equally long ones."""
    found = bounds(x, order, bench.words, bench.suffixes, bench.sizes, False)
    before = np.searchsorted(found, np.arange(len(order)), "right") - 1  # the last suffix of the benchmark not after
    size, test = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for near in (before, before + 1):
        own = np.flatnonzero((near >= 0) & (near < len(found)))
        place = bench.suffixes[near[own]]
        match = common_prefix(x, order[own], bench.words, place, window)
        longer = match > size[own]
        size[own[longer]], test[own[longer]] = match[longer], place[longer]
    docs = np.searchsorted(starts, order, "right") - 1
    best = np.lexsort((order, -size, docs))
    best = best[np.append(True, docs[best][1:] != docs[best][:-1])[: len(best)]]
    for k in best[size[best] > 0].tolist():
        yield int(docs[k]), int(size[k]), int(order[k] - starts[docs[k]]), bench.item_at[test[k]]


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining ranges as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _pass(rows: DataFrame, carried: list[str], bench: Benchmark, window: int) -> DataFrame:
    """Search one pass of items; what an earlier pass found is in ``rows`` and is added to."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(bench))
    names = [c.split()[0] for c in SCHEMA.split(" | ")]
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string()),
             pa.int32(), pa.int32(), pa.string()]
    again = "n_words" in rows.columns[len(carried) :]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, size, upto = [], 0, first
                while upto < batch.num_rows and (size < SHARD or not texts):
                    texts.append(batch.column(len(carried))[upto].as_py() or b"")
                    size += len(texts[-1])
                    upto += 1
                found = list(matched(texts, Benchmark(**sent.value), window))
                part = batch.slice(first, upto - first)
                if again:
                    before = zip(*(c.to_pylist() for c in part.columns[len(carried) + 1 :]))
                    found = [_added(a, b) for a, b in zip(before, found)]
                columns = list(zip(*found))
                columns[1] = [[{"first": a, "last": b} for a, b in v] for v in columns[1]]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(carried) + 1], *(pa.array(c, k) for c, k in zip(columns, kinds))], [*carried, "text", *names])
                first = upto

    kept = rows.select(*carried, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return rows.mapInArrow(search, ", ".join([*fields, *SCHEMA.split(" | ")]))


def _added(before: tuple, now: tuple) -> tuple:
    words, hits, items, *best = now
    hits = _joined([(h["first"], h["last"]) for h in before[1]] + hits)
    return words, hits, sorted({*before[2], *items}), *min(before[3:], best, key=lambda b: (-b[0], b[1] or 0))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, carried: tuple[str, ...] = ("doc_id",),
                      pass_words: int = PASS_WORDS) -> DataFrame:
    """What of the benchmark each document repeats.

    Returns the ``carried`` columns and ``n_words``, ``hits`` (ranges of
    document words covered by a window of ``window`` item words), ``items``
    (ids, as sorted strings, of items with an occurring window; an item of
    fewer words is one window) and the longest verbatim match of any length:
    ``longest`` in words, ``longest_at`` (its first place), ``longest_item``
    (an item that has it). Without a common word these are 0, null and null.

    The benchmark is the stated query set: it is sent to the tasks in passes
    of about ``pass_words`` words (a bound on the broadcast), and a larger one
    takes several passes over the documents. Null texts have no words, a null
    item id is an empty name, repeated items count once, an empty benchmark or
    document table is allowed, further columns are left out.
    """
    own = [f"_c{i}" for i in range(len(carried))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carried, own)], F.col("text").cast("binary").alias("text"))
    items, size, passes = [], 0, 0
    for item in only(benchmark, "item_id", "text").sort("item_id", "text").toLocalIterator():
        if size >= pass_words:
            rows = staged(_pass(rows, own, prepared(items, window), window), "decontamination")
            items, size, passes = [], 0, passes + 1
        items.append((item["item_id"], item["text"]))
        size += len(words_of(item["text"]))
    rows = _pass(rows, own, prepared(items, window), window)
    return rows.select(*[F.col(n).alias(c) for c, n in zip(carried, own)], *[c.split()[0] for c in SCHEMA.split(" | ")])


def hit_words(hits: Column) -> Column:
    """Number of words in the ranges of ``hits``."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    return benchmark_matches(docs, benchmark, window, tuple(docs.columns)).filter(F.size("hits") == 0).select(docs.columns)
