"""Removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the run of ``MINIMISER`` words in it with the smallest
hash. Consecutive windows that share one travel as one packed string (a
super-k-mer) to the bucket of that minimiser, so equal windows meet in one
bucket whatever stands around them, at about three times the text instead of
as many times as a window has words. There sorting brings equal windows
together: the first place of each stays, all other places are removed.

Runs of words that very many documents share would make one bucket heavy: they
are found in a bounded sample and taken as minimisers only where a window has
no other. A bucket that still outgrows a task hands on its windows one by one,
and these are grouped by their words. Neither changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

#: Words of a minimiser.
MINIMISER = 5
#: Bytes of text taken at once, of packed strings a bucket is meant to hold, and that a task holds of one bucket at most.
CHUNK, BUCKET, MOST = 4 << 20, 32 << 20, 160 << 20
#: Documents read for frequent runs of words, and the share of them that makes a run frequent.
SAMPLE, FREQUENT = 4096, 0.005

FOUND = "id long, unknown boolean, hash long, start long, n long, window binary"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 1 << 18:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs_of_words(hashes: np.ndarray, m: int = MINIMISER) -> np.ndarray:
    """A hash for the ``m`` words from each place on."""
    out = np.zeros(max(0, len(hashes) - m + 1), np.uint64)
    for i in range(m):
        out = (out ^ hashes[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


def least_places(runs: np.ndarray, frequent: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` consecutive runs stands, the leftmost of equals; frequent runs come last."""
    rank = runs >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        rank |= (frequent[at] == runs).astype(np.uint64) << np.uint64(63)
    least = (rank >> np.uint64(24) << np.uint64(24)) | np.arange(len(runs), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _pieces(text: str | None, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text and where they start in it, in pieces that share ``window - 1`` words."""
    raw = (text or "").encode()
    if len(raw) <= CHUNK:
        yield 0, raw.split()
        return
    at, start, carried = 0, 0, []
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        words = carried + raw[at:end].split()
        yield start, words
        carried = words[max(0, len(words) - window + 1) :]
        start += len(words) - len(carried)
        at = end


class Chunk:
    """The super-k-mers of some documents. A document is ``(id is null, id, hash)``; repeats within the chunk are settled here."""

    def __init__(self, window: int, buckets: int, frequent: np.ndarray):
        self.window, self.buckets, self.frequent, self.hashes = window, buckets, frequent, Words()
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.docs: list[tuple[bool, int, int]] = []
        self.starts: list[int] = []  # in the document, of each piece
        self.begins: list[int] = []  # in the chunk
        self.size = 0

    def add(self, doc: tuple[bool, int, int], start: int, words: list[bytes]) -> None:
        if len(words) < self.window:
            return
        self.docs.append(doc)
        self.starts.append(start)
        self.begins.append(len(self.words))
        self.words += words
        self.size += sum(map(len, words)) + 8 * len(words)

    def full(self) -> bool:
        return self.size >= 2 * CHUNK

    def super_kmers(self) -> tuple[dict, list]:
        """Packed string -> ``[key, first place, number of windows]``, and the places of repeats ``(place, number)``."""
        words, window = self.words, self.window
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offset = np.append(0, np.cumsum(lengths + 1))
        text = b" ".join(words)
        runs = runs_of_words(self.hashes.hashes(words))
        least = least_places(runs, self.frequent, window - MINIMISER + 1)
        begins = np.array(self.begins)
        piece = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(words))))
        at = np.arange(len(least))
        whole = piece[at] == piece[at + window - 1]
        at = at[whole]
        cut = np.flatnonzero(np.r_[True, (least[at][1:] != least[at][:-1]) | (at[1:] != at[:-1] + 1)])
        first, count = at[cut], np.diff(np.append(cut, len(at)))
        keys = runs[least[first]]
        upto = offset[first + count + window - 1] - 1
        owner = piece[first]
        packed: dict[bytes, list] = {}
        again = []
        docs, starts = self.docs, self.starts
        for key, f, n, a, b, p in zip(keys.tolist(), first.tolist(), count.tolist(), offset[first].tolist(), upto.tolist(), owner.tolist()):
            null, ident, h = docs[p]
            place = (null, ident, f - self.begins[p] + starts[p], h)
            found = packed.setdefault(text[a:b], [key, place, n])
            if found[1] is not place and found[1] != place:
                if place < found[1]:
                    found[1], place = place, found[1]
                again.append((place, n))
        return packed, again

    def blobs(self) -> Iterator[tuple[int, bytes, int]]:
        """``bucket, packed strings with their places, bytes``; repeats ride along in any bucket."""
        if not self.words:
            return
        packed, again = self.super_kmers()
        self.clear()
        texts, values = list(packed), list(packed.values())
        bucket = np.fromiter(((v[0] * 0xD6E8FEB86659FD93 >> 32) % self.buckets for v in values), np.int64, len(values))
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else []
        for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(order)])):
            own = order[a:b].tolist()
            blob = write_blob([texts[i] for i in own], [values[i] for i in own], again if k == 0 else [])
            yield int(bucket[own[0]]), pa.compress(blob, "zstd", asbytes=True), len(blob)


def _places(places: list[tuple]) -> list[np.ndarray]:
    return [np.array([p[i] for p in places], kind) for i, kind in enumerate(("?", "i8", "i8", "i8"))]


def write_blob(texts: list[bytes], values: list[list], again: list) -> bytes:
    columns = [np.array([len(texts), len(again)], "i8"), np.array([v[0] for v in values], "u8"), np.array([v[2] for v in values], "i8"),
               np.array([len(t) for t in texts], "i8"), *_places([v[1] for v in values]), *_places([p for p, _ in again]),
               np.array([n for _, n in again], "i8")]
    return b"".join(c.tobytes() for c in columns) + b"".join(texts)


def read_blob(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    """Keys, counts, lengths and places (four arrays) of the packed strings; places and counts of the repeats; the strings."""
    n, r = np.frombuffer(blob, "i8", 2).tolist()
    at, out = 16, []
    for size, kind in [(n, "u8"), (n, "i8"), (n, "i8"), *[(n, k) for k in ("?", "i8", "i8", "i8")], *[(r, k) for k in ("?", "i8", "i8", "i8")], (r, "i8")]:
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return out[:7], out[7:], blob[at:]


class Bucket:
    """What a task holds of one bucket."""

    def __init__(self, window: int):
        self.window, self.size = window, 0
        self.parts: list[tuple[list[np.ndarray], bytes]] = []

    def add(self, columns: list[np.ndarray], text: bytes) -> None:
        self.parts.append((columns, text))
        self.size += len(text) + 64 * len(columns[0])

    def _columns(self) -> tuple[list[np.ndarray], bytes]:
        return [np.concatenate([c[i] for c, _ in self.parts]) for i in range(7)], b"".join(t for _, t in self.parts)

    def windows(self) -> Iterator[tuple[bytes, tuple]]:
        """All windows one by one, for buckets that outgrow a task."""
        columns, text = self._columns()
        ends = np.cumsum(columns[2])
        for i in range(len(ends)):
            yield from self._split(columns, text, ends, i)

    def _split(self, columns: list[np.ndarray], text: bytes, ends: np.ndarray, i: int) -> Iterator[tuple[bytes, tuple]]:
        end = int(ends[i])
        words = text[end - int(columns[2][i]) : end].split(b" ")
        null, ident, start, h = (c[i].item() for c in columns[3:7])
        for k in range(len(words) - self.window + 1):
            yield b" ".join(words[k : k + self.window]), (null, ident, start + k, h)

    def repeats(self) -> Iterator[tuple[tuple, int]]:
        """Places of windows that also start earlier, and how many of them follow one another."""
        if not self.parts:
            return
        columns, text = self._columns()
        ends = np.cumsum(columns[2])
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        # A super-k-mer that is alone with its minimiser holds no window twice: its windows have the minimiser at different places.
        for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
            own: dict[bytes, int] = {}
            for i in order[a:b].tolist():
                end = int(ends[i])
                packed = text[end - int(columns[2][i]) : end]
                other = own.setdefault(packed, i)
                if other != i:
                    p, q = (tuple(c[j].item() for c in columns[3:7]) for j in (other, i))
                    if q < p:
                        own[packed] = i
                    if p != q:
                        yield max(p, q), int(columns[1][i])
            if len(own) > 1:
                found = sorted(w for i in own.values() for w in self._split(columns, text, ends, i))
                for _, same in groupby(found, key=lambda w: w[0]):
                    first = next(same)[1]
                    for _, place in same:
                        if place != first:
                            yield place, 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    places = [r[0] for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[1] for p in places], pa.int64()), pa.array([p[0] for p in places], pa.bool_()), pa.array([p[3] for p in places], pa.int64()),
         pa.array([p[2] for p in places], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names=["id", "unknown", "hash", "start", "n", "window"])


def _pack(window: int, buckets: int, frequent):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(window, buckets, frequent.value)

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, blob, size in chunk.blobs():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], names=["bucket", "blob", "size"])

        for batch in batches:
            ids, unknown, hashes = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(batch.column(3)):
                doc = (unknown[i], ids[i], hashes[i])
                for start, words in _pieces(text.as_py(), window):
                    chunk.add(doc, start, words)
                    if chunk.full():
                        yield from flush()
        yield from flush()

    return pack


def _sort(window: int, most: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, now, over = Bucket(window), None, False
            for batch in batches:
                for bucket, blob, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    if bucket != now:
                        yield from ((p, n, None) for p, n in held.repeats())
                        held, now, over = Bucket(window), bucket, False
                    columns, again, text = read_blob(pa.decompress(blob.as_buffer(), size, "zstd", asbytes=True))
                    for *place, n in zip(*(c.tolist() for c in again)):
                        yield tuple(place), n, None
                    held.add(columns, text)
                    if over or held.size > most:
                        # What is known of the bucket goes on window by window, and all that follows too.
                        yield from ((p, 1, w) for w, p in held.windows())
                        held, over = Bucket(window), True
            yield from ((p, n, None) for p, n in held.repeats())

        kept: list[tuple] = []
        for row in rows():
            kept.append(row)
            if len(kept) == 8192:
                yield _batch(kept)
                kept = []
        if kept:
            yield _batch(kept)

    return sort


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``n_words, n_removed, text``: the words that no listed window covers."""
    for batch in batches:
        n_words, n_removed, texts = [], [], []
        starts = batch.column(1)
        for text, places in zip(batch.column(0), starts):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if not places.is_valid:
                n_removed.append(0)
            else:
                edge = np.zeros(len(words) + 1, np.int64)
                flat = places.values.to_numpy(zero_copy_only=False)
                np.add.at(edge, flat[0::2], 1)
                np.add.at(edge, flat[0::2] + flat[1::2] + window - 1, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                n_removed.append(len(words) - len(kept))
                words = [words[i] for i in kept.tolist()]
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
            names=[*batch.schema.names[2:], "n_words", "n_removed", "text"])


def frequent_runs(rows: DataFrame, count: int, window: int, sample: int = SAMPLE, share: float = FREQUENT) -> np.ndarray:
    """Hashes of the runs that at least ``share`` of about ``sample`` documents hold: at most the sample's runs over that number."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for text in batch.column(3):
                found = [np.unique(runs_of_words(words.hashes(w))) for _, w in _pieces(text.as_py(), window)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["run"])

    drawn = rows.filter(F.pmod(F.xxhash64("hash", "id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(count, 1))))
    least = max(8, int(share * min(sample, count)))
    # More than a few documents of the sample: the list stays below the sample's words / least.
    found = drawn.mapInArrow(runs, "run long").groupBy("run").count().filter(F.col("count") >= least).select("run").toPandas()
    return np.sort(found["run"].to_numpy(np.int64).view(np.uint64))


def _keyed() -> list[Column]:
    """What names a row: its id, whether that is null, and a hash of its text."""
    ident = F.col("doc_id").cast("long")
    return [F.coalesce(ident, F.lit(0)).cast("long").alias("id"), ident.isNull().alias("unknown"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")]


def without_repeated_windows(documents: DataFrame, window: int = 20, most: int = MOST, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: texts without the windows of ``window`` words that also start earlier.

    Earlier means in a document of smaller ``doc_id``, or further to the front
    of the same. Words are runs of characters other than white space; those
    that stay are joined by one space. All windows are judged on the input.

    Null and empty texts have no words; texts shorter than a window stay.
    Null ids come after all others. Documents that share an id count as one
    document at each place, the smaller hash of the text first; rows repeated as a
    whole have equal places, so neither removes from the other and both get
    the same result. Very long texts are read in pieces. ``most`` bounds the
    bytes that a task holds of one bucket; a larger bucket's windows are
    grouped one by one. ``sample`` bounds the documents read for frequent
    runs of words, which steer windows to buckets and nothing else.
    """
    if window < MINIMISER:
        raise ValueError(f"a window needs at least {MINIMISER} words")
    spark = documents.sparkSession
    docs = only(documents, "doc_id", "text")
    rows = docs.select(*_keyed(), F.col("text").alias("words_of"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("words_of")), F.lit(0)).alias("bytes")).first()
    frequent = spark.sparkContext.broadcast(frequent_runs(rows, total.n, window, sample))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, -(-4 * total.bytes // BUCKET))
    packed = rows.mapInArrow(_pack(window, buckets, frequent), "bucket int, blob binary, size long")
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = staged(dealt.mapInArrow(_sort(window, most), FOUND), "windows")
    places = found.filter(F.col("window").isNull()).drop("window")
    if not found.filter(F.col("window").isNotNull()).isEmpty():
        single = found.filter(F.col("window").isNotNull()).withColumn("place", F.struct("unknown", "id", "start", "hash"))
        first = single.groupBy("window").agg(F.min("place").alias("first"))
        places = places.unionByName(single.join(first, "window").filter(F.col("place") > F.col("first")).drop("window", "place", "first"))
    listed = places.groupBy("id", "unknown", "hash").agg(F.flatten(F.collect_list(F.array("start", "n"))).alias("places"))
    joined = docs.select(*_keyed(), "doc_id", F.col("text").alias("words_of")).join(listed, ["id", "unknown", "hash"], "left").select("words_of", "places", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lambda batches: _cut(batches, window), f"doc_id {kind}, n_words long, n_removed long, text string")
