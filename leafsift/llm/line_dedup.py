"""Line dedup over levelled sorted runs of line hashes.

The store works like a log-structured index. A batch of documents is reduced
to (line hash, number of documents), loses by a merge anti-join the hashes
that the store already knows to be common, and becomes a sorted run of level
0. As soon as a level has ``fanout`` runs they are merged into one run of the
next level, and hashes whose documents add up to the threshold move to the
run of common hashes. Batches may be added at any time.

Hashes are two independent 64-bit values, so chance collisions do not occur
in practice at any size. All work is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import WHITE, ascii_lower, only, staged

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, hashes``: per row the hashes of its line keys, null for keys that are too short."""

    def hashed(line: Column) -> Column:
        return F.transform(
            F.array(line_key(line)),
            lambda k: F.when(
                F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
            ),
        )[0]

    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"),
                       F.transform(lines_of(F.col("text")), hashed).alias("hashes"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """Levelled sorted runs of ``h1, h2, n`` with the common hashes apart."""

    def __init__(self, min_docs: int, fanout: int = 3):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.common: DataFrame | None = None

    def add(self, counts: DataFrame) -> None:
        """Add a batch, given as distinct hashes with their numbers of documents."""
        self._put(0, self._unknown(counts))

    def common_hashes(self) -> DataFrame:
        """Merge all runs; the hashes in at least ``min_docs`` documents."""
        runs = [run for level in self.levels for run in level]
        self.levels = [[self._merged(runs)]]
        return self.common

    def _unknown(self, counts: DataFrame) -> DataFrame:
        return counts if self.common is None else counts.join(self.common, HASH, "left_anti")

    def _put(self, level: int, counts: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._run(counts))
        if len(self.levels[level]) == self.fanout:
            rest = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, rest)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs' sum; hashes that have become common go to ``common``, the others are returned."""
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        total = self._run(self._unknown(both.groupBy(*HASH).agg(F.sum("n").alias("n"))))
        found = total.filter(F.col("n") >= self.min_docs).select(*HASH)
        self.common = self._run(found if self.common is None else self.common.unionByName(found))
        return total.filter(F.col("n") < self.min_docs)

    @staticmethod
    def _run(counts: DataFrame) -> DataFrame:
        return staged(counts.sortWithinPartitions(*HASH), "line-run")


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` rows of ``docs``.

    The key is the line without white space at its ends, A-Z lower-cased; keys
    of fewer than ``min_chars`` code points are never dropped. Returns one row
    per row of ``docs``: its columns, with the kept lines as ``text``, and
    ``n_lines`` (before), ``n_dropped``.

    Null text counts as one empty line and stays null, an empty table gives an
    empty result, repeated rows count as documents of their own and get the
    same result, and further columns pass through (``n_lines``, ``n_dropped``
    are replaced if present).
    """
    hashes = staged(hashed_lines(only(docs, "doc_id", "text"), min_chars), "line-hashes")
    counts = staged(
        hashes.select(F.pmod("text_hash", F.lit(batches)).cast("int").alias("batch"),
                      F.explode(F.array_compact(F.array_distinct("hashes"))).alias("h"))
        .groupBy("batch", "h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")),
        "line-counts", "batch",
    )
    runs = LineRuns(min_docs)
    for batch in range(batches):
        runs.add(counts.filter(F.col("batch") == batch).drop("batch"))
    common = runs.common_hashes()

    at = hashes.select("doc_id", "text_hash", F.posexplode("hashes").alias("pos", "h")).filter(F.col("h").isNotNull())
    hits = (
        at.select("doc_id", "text_hash", "pos", "h.h1", "h.h2")
        .join(common, HASH, "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_hits"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_hits")
    )
    rows = docs.drop("n_lines", "n_dropped").withColumn("_own", text_hash(F.col("text")))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash")), "left")
    lines = lines_of(F.col("text"))
    kept = F.transform(
        F.array(lines),
        lambda ls: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_hits")), lambda i: F.get(ls, i)),
            "\n"),
    )[0]
    return joined.select(
        *[F.when(F.col("_hits").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c)
          for c in rows.columns if c != "_own"],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_hits"), F.lit(0)).cast("long").alias("n_dropped"),
    )
