"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints
at most 2 bits apart, either the high segments are within one bit, or the low
segments are equal: so the Hamming ball of radius 1 around the high segment
and of radius 0 around the low one are enumerated and looked up. What may
still differ in the other segment then also leaves some part of that segment
equal, and this part joins the key, so that many fingerprints with one
segment in common do not meet in one bucket. Fetched pairs are verified by
their whole distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged
from leafsift.llm.graph import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = re.compile(rb"[\x20\x09-\x0d]+")
#: Shingles hashed before their bits are added up.
BLOCK = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles, each as often as it occurs; 0 for a text without words."""
    import xxhash

    # Bytes of UTF-8 sequences are never white space or letters A-Z.
    joined = SPACES.sub(b" ", (text or "").encode().translate(LOWER)).strip(b" ")
    if not joined:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(starts) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        first, last = starts[at:upto].tolist(), ends[np.arange(at, upto) + min(words, len(starts)) - 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > n)
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, words: int = 3, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carried`` columns and ``fp`` (as a signed long) for every row; null and empty texts have 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(len(carried))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.int64())], [*carried, "fp"])

    rows = only(docs, *carried, "text")
    return rows.mapInArrow(compute, rows.drop("text").schema.add("fp", "long"))


def _bits(value: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1))


def _key(kind: int, segment: Column, part: int, value: Column) -> Column:
    return F.struct(F.lit(kind * 8 + part).alias("t"), segment.alias("s"), value.alias("p"))


def near_pairs(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b`` for all pairs of distinct ``fp`` at most 2 bits apart (``bits`` may be 0, 1 or 2)."""
    if not 0 <= bits <= 2:
        raise ValueError("the tables are made for at most 2 bits")
    high, low = _bits(F.col("fp"), 32, 32), _bits(F.col("fp"), 0, 32)
    thirds, halves = ((0, 11), (11, 11), (22, 10)), ((0, 16), (16, 16))
    # High segments equal, two bits in the low one at most: one third of it is equal. And the other way round.
    same = [_key(0, high, i, _bits(low, *p)) for i, p in enumerate(thirds)] + [_key(1, low, i, _bits(high, *p)) for i, p in enumerate(thirds)]
    # High segments one bit apart, one bit in the low one at most: one half of it is equal. The fingerprint with the bit
    # unset looks up the ball of radius 1, the one with the bit set stands in the table.
    held = [_key(2, high, i, _bits(low, *p)) for i, p in enumerate(halves)]
    ball = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", high, i).bitwiseAND(F.lit(1)) == 0),
        lambda i: F.array(*[_key(2, high.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), j, _bits(low, *p))
                            for j, p in enumerate(halves)])))
    table = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*same, *held)).alias("k"))
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(F.array(*same), ball)).alias("k"))
    found = probe.select("a", "k.t", "k.s", "k.p").join(table.select("b", "k.t", "k.s", "k.p"), ["t", "s", "p"])
    # Equal segments show a pair from both sides; a ball shows it from one.
    once = (F.col("t") >= 16) | (F.col("a") < F.col("b"))
    return found.filter(once & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id, root`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable over links of at most
    ``bits`` differing bits, itself included. Rows with one fingerprint are one
    node, so copies are never expanded into pairs. Null and empty texts share
    fingerprint 0 and link like any other; rows with a null id get the least
    id of their component and never name one; repeated rows get the same
    answer; empty tables give no rows; further columns are left out.
    """
    prints = fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words)
    return in_components(staged(prints, "fingerprints"), bits)


def in_components(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Add ``component_id`` to rows of ``doc_id, fp``."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(near_pairs(nodes.select("fp"), bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staged(rooted, "fingerprint-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "root")
    return prints.join(of_print, "fp")


def one_of_each_group(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the least id.

    Among rows with that id, and where a component has no id at all, the least
    row by the hash of its content stays; of identical rows one.
    """
    hashes = {"_h1": F.xxhash64(*docs.columns), "_h2": F.xxhash64(F.lit(1), *docs.columns)}
    rows = docs.select(F.col("doc_id").cast("long"), "text", *[h.alias(n) for n, h in hashes.items()])
    prints = staged(fingerprints(rows, words, ("doc_id", "_h1", "_h2")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2"))
    kept = in_components(prints, bits).groupBy("root").agg(first.alias("k")).select("k._h1", "k._h2")
    # Both sides are dealt by the row hash, which also brings identical rows together.
    return docs.withColumns(hashes).join(kept, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"]).select(docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
