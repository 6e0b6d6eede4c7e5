"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by (hash of the text, hash of the id), so that equal texts
lie together. Splitters are quantiles of a sample in which a row is drawn
with a probability in proportion to its size; the records are partitioned by
range, ranges that turn out overfull are subdivided by splitters of their
own, and the exact sums of the ranges give every record its place in the
whole order, and with it its shard. The result depends on the order alone,
not on the sample. All work is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

#: Sorts after every key.
LAST = "~"


def order_key(text: Column, doc_id: Column) -> Column:
    """32 hex digits: 16 of the text's md5, 16 of the id's. A group of equal texts can still be split by id."""
    part = lambda c: F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 16)
    return F.concat(part(text), part(doc_id.cast("string")))


def range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key, by binary search."""
    depth = max(1, len(splitters).bit_length())
    padded = splitters + [LAST] * ((1 << depth) - 1 - len(splitters))
    table = F.split(F.lit(",".join(padded)), ",")
    steps = F.array(*[F.lit(1 << d) for d in range(depth - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at)
    )


def sampled_splitters(notes: DataFrame, total: float, ranges: int, salt: int = 0, per_range: int = 32) -> list[str]:
    """Quantile boundaries of a load-weighted sample of about ``ranges * per_range`` keys."""
    rate = ranges * per_range / max(total, 1)
    chance = F.xxhash64("key", F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = [r.key for r in notes.filter(chance < F.col("load") * rate).select("key").sort("key").collect()]
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def shard_by_bytes(docs: DataFrame, shards: int = 16, rows_per_range: int = 50_000, most_ranges: int = 1 << 14) -> DataFrame:
    """Put every row into one of ``shards`` shards of equal bytes, to within one record.

    The size of a row is the UTF-8 bytes of its text plus 1. Returns
    ``doc_id, size, text_crc32, shard, slot``; ``slot`` numbers the rows of a
    shard without gaps from 0. ``most_ranges`` bounds the splitters that the
    driver holds; beyond it ranges grow, and their sorts spill. The load that
    the splitters even out is size plus mean size, so that no range holds too
    many small rows either.

    A null text counts as empty, a null id sorts as an empty one, repeated
    rows take places next to each other, an empty table gives no rows, and
    further columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    notes = staged(
        only(docs, "doc_id", "text").select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            order_key(F.col("text"), F.col("doc_id")).alias("key")),
        "shard-notes")
    rows, total = notes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    loaded = notes.withColumn("load", F.col("size") + F.lit(total / max(rows, 1)))
    ranges = min(most_ranges, max(4 * shards, rows // rows_per_range))
    most = 2 * (2 * total / ranges)
    splitters = sampled_splitters(loaded, 2 * total, ranges)
    while True:
        ranged = loaded.withColumn("range", range_of(F.col("key"), splitters))
        sums = staged(ranged.groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("load").alias("load"),
            (F.min("key") < F.max("key")).alias("splits")), "shard-sums")
        full = sums.filter((F.col("load") > most) & F.col("splits")).select("range", "load").collect()
        load = sum(r["load"] for r in full)
        more = sampled_splitters(ranged.filter(F.col("range").isin([r["range"] for r in full])), load,
                                 max(2, 2 * round(load / most)) * 2, len(splitters)) if full else []
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})

    # One row per range, most_ranges and their subdivisions at most.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("range").orderBy("key", "doc_id")
    placed = staged(
        ranged.withColumn("nth", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, "range")
        .select("doc_id", "size", "text_crc32", (F.col("n0") + F.col("nth") - 1).alias("row"),
                # The shard that holds the middle of the record.
                F.least(F.lit(shards - 1), F.expr(f"(2 * (b0 + upto) - size) * {shards} div {2 * max(total, 1)}"))
                .cast("int").alias("shard")),
        "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))
