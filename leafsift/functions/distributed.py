"""Skew-proof building blocks: exact ranks and joins with no unbounded task.

A plain ``row_number() over (partition by report)`` puts a whole report into
one task, and one report may hold a third of all rows. The rank here is built
in steps instead: rank inside small cells, add up cell counts, shift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input: sorted and merged, never broadcast.

    Spark sizes a written table by its compressed files and does not count what
    a generator multiplies, so a side of some hundred megabytes can pass its
    check for a broadcast and then has to fit into the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[Column | str],
    out: str,
) -> DataFrame:
    """Exact 1-based row number within ``keys``, computed cell by cell.

    ``levels`` lists the cell columns from coarse to fine; they must not
    decrease along ``order``. A task sees the rows of one finest cell, or the
    counts of the cells below one coarser cell.
    """
    keys = list(keys)
    paths = [keys + [c for level in levels[: d + 1] for c in level] for d in range(len(levels))]
    local = df.withColumn("_in_cell", F.row_number().over(Window.partitionBy(*paths[-1]).orderBy(*order)))

    counts = df.groupBy(*paths[-1]).agg(F.count(F.lit(1)).alias("_n"))
    shifts = None
    for depth in range(len(levels) - 1, -1, -1):
        parent = paths[depth - 1] if depth else keys
        # The coarsest level of a keyless rank has few rows by construction of the cells.
        before = (
            Window.partitionBy(*(parent or [F.lit(0)]))
            .orderBy(*levels[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        step = step.drop("_n")
        if shifts is None:
            shifts = step
        else:
            shifts = (
                shuffled_join(shifts, step.withColumnRenamed("_shift", "_up"), paths[depth])
                .withColumn("_shift", F.col("_shift") + F.col("_up"))
                .drop("_up")
            )
        if depth:
            counts = counts.groupBy(*parent).agg(F.sum("_n").alias("_n"))
    return (
        shuffled_join(local, shifts, paths[-1])
        .withColumn(out, F.col("_shift") + F.col("_in_cell"))
        .drop("_shift", "_in_cell")
    )


def rank_by_hash(
    df: DataFrame, keys: Sequence[str], ident: Column, seed: int, out: str
) -> DataFrame:
    """Seeded exact shuffle rank within ``keys``: order by md5(id, seed).

    The first hex digits of the hash are the cells, so even a single huge class
    is spread over 4,096 x 256 cells, and the sums run over at most 4,096 rows.
    """
    digest = F.md5(F.concat(ident.cast("string"), F.lit(f"|{seed}")))
    hashed = (
        df.withColumn("_h", digest)
        .withColumn("_h1", F.substring("_h", 1, 3))
        .withColumn("_h2", F.substring("_h", 4, 2))
    )
    ranked = rank_rows(hashed, keys, [["_h1"], ["_h2"]], ["_h"], out)
    return ranked.drop("_h", "_h1", "_h2")


def salted_semi_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, salts: int = 16
) -> DataFrame:
    """Left-semi join that splits a hot key of ``left`` over ``salts`` tasks.

    ``right`` must hold key rows only; each is repeated once per salt, so it
    should be the small, already distinct side.
    """
    on = list(on)
    salted = left.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    keys = right.select(*on, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return shuffled_join(salted, keys, on + ["_salt"], "left_semi").drop("_salt")


def salted_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, salts: int = 16
) -> DataFrame:
    """Left join on a unique-key ``right`` side, hot keys of ``left`` split as above."""
    on = list(on)
    salted = left.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return shuffled_join(salted, many, on + ["_salt"], "left").drop("_salt")


def explode_rows(df: DataFrame, values: Column, out: str) -> DataFrame:
    """One row per non-null element of ``values``.

    A plain ``explode`` makes the optimiser test the array for emptiness below
    the projections it comes from, which computes an expensive array twice;
    the outer form with a filter on its output does not.
    """
    return df.withColumn(out, F.explode_outer(values)).filter(F.col(out).isNotNull())


def fixed_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters use as they are.

    The optimiser moves a filter below the projection of its column and so
    computes an expensive expression again, once per use; it does not move a
    filter below a generator.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    out = df.withColumn("_made", F.explode_outer(made))
    return out.select(*df.columns, *[F.col(f"_made.{name}").alias(name) for name in columns])
