"""Best-fit decreasing packing of token sequences.

Lengths are small integers, so the whole corpus is planned from its histogram
of lengths: documents of one length and open bins of one remaining capacity
are interchangeable, and best-fit decreasing moves whole runs of them at once.
A segment tree over the remaining capacities finds the tightest open bin. The
plan says which ranks of a length go to which bins; Spark ranks the pieces
within their length and joins them with it. The outcome is that of best-fit
decreasing over all documents one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.functions.distributed import rank_rows
from leafsift.llm.common import only, staged

END = 2
#: Texts beyond this are encoded in parts, cut where no token crosses.
PART = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of the byte-level BPE vocabulary in ``tokenizers``.

    The rank file of the same vocabulary gives the same ids several times
    faster; texts that hold the name of a special token go to ``tokenizers``.
    """

    def __init__(self, json_file: str, rank_file: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json_file, self._full = json_file, None

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" in text:
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._json_file)
            return self._full.encode(text, add_special_tokens=False).ids
        if len(text) <= PART:
            return self._fast.encode_ordinary(text)
        ids: list[int] = []
        for part in _parts(text):
            ids += self._fast.encode_ordinary(part)
        return ids


def _parts(text: str) -> Iterator[str]:
    """Cut before a space that stands between a non-space and a letter: a token starts there in any case."""
    at = 0
    safe = re.compile(r"(?<=\S) (?=[A-Za-z])")
    while len(text) - at > PART:
        found = safe.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_pieces(docs: DataFrame, capacity: int = 1024, json_file: str | None = None, rank_file: str | None = None,
                 with_ids: bool = False) -> DataFrame:
    """Encode ``doc_id, text``, end each document with id 2 and cut those of more than ``capacity`` ids.

    Pieces have ``capacity`` ids but for the first of a cut document, which
    takes the remainder. ``with_ids`` adds the ids themselves. Null texts are
    empty and give the end id alone.
    """
    import public_tokenizers

    files = (json_file or public_tokenizers.path("byte_bpe_50k.json"), rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files)
        rows: dict[str, list] = {c: [] for c in columns}
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.list_(pa.int32())}
            out = pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], columns)
            for values in rows.values():
                values.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array(encoder(text.as_py() or "") + [END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = ids[start:end]
                    values = (doc_id.as_py(), piece, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)
                    for column, value in zip(columns, values):
                        rows[column].append(value)
                held += len(ids) if with_ids else 1
                if held > (1 << 18 if with_ids else 10_000):
                    yield flush()
                    held = 0
        yield flush()

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)


class CapacityTree:
    """Segment tree over remaining capacities: the least one, at or above a length, that has an open bin."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, at: int, by: int) -> None:
        at += self.width
        while at:
            self.count[at] += by
            at //= 2

    def tightest(self, length: int) -> int | None:
        at = length + self.width
        while not self.count[at]:
            while at & 1:  # a right child: go up
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # beyond the last leaf
                return None
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, last rank, first bin, offset`` for runs of documents, as best-fit decreasing places them.

    A run of bins with equal remaining capacity takes as many documents of a
    length each as fit, since a bin just used is then the tightest one.
    """
    tree, open_bins, plan, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, count = capacity, bins, None
            else:
                start, count = open_bins[room].popleft()
                tree.add(room, -count)
            each = room // length
            used = left // each if count is None else min(count, left // each)
            if not used:  # the last few share one bin
                used, each = 1, left
            if count is None:
                bins += used
            elif count > used:
                open_bins[room].appendleft((start + used, count - used))
                tree.add(room, count - used)
            for k in range(each):
                plan.append((length, rank, rank + used - 1, start, capacity - room + k * length))
                rank += used
            left -= used * each
            rest = room - each * length
            if rest:
                open_bins.setdefault(rest, deque()).append((start, used))
                tree.add(rest, used)
    return plan


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces`` (with ``doc_id, piece, length, ids_crc32``).

    Only the histogram (at most ``capacity`` rows) visits the driver. An empty
    table gives no rows; repeated pieces are packed as pieces of their own.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity),
                                 "length long, _first long, _last long, _bin long, offset long")
    mixed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    mixed = mixed.withColumn("_c1", F.shiftrightunsigned("_h", 54)).withColumn("_c2", F.shiftrightunsigned("_h", 46))
    ranked = rank_rows(mixed, ["length"], [["_c1"], ["_c2"]], [F.shiftrightunsigned("_h", 1), "doc_id", "piece"], "_rank")
    # The plan depends on the distinct lengths and room left, a few thousand rows for any corpus.
    placed = ranked.withColumn("_rank", F.col("_rank") - 1).join(F.broadcast(plan.withColumnRenamed("length", "_length")), (
        F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    return placed.select(*pieces.columns, (F.col("_bin") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, **files: str) -> DataFrame:
    """Encode, cut and pack all documents: one row per piece with its sequence and place."""
    return packed(staged(token_pieces(docs, capacity, **files), "pieces"), capacity)
