"""Running totals over ordered groups of any size.

A plain window puts a whole group into one task. Here each group is cut into
blocks of its position column, so a task sees at most one block of a group:

1. every block is summed (partial aggregation on the map side),
2. the block sums are added up per group; one row per block,
3. each block starts with one *opening row* carrying what came before it, and
   the running total is an ordinary window inside the block.

Block edges depend only on the position value, hence a re-run task finds the
same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block_of(pos: str, block: int) -> Column:
    return F.expr(f"`{pos}` div {int(block)}L")


def so_far(*partition: str, order: Sequence[str]):
    """Window from the first row of the partition to the current one."""
    return (
        Window.partitionBy(*partition)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def before(*partition: str, order: Sequence[str]):
    """Window over the rows strictly before the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows by ``keys`` over all shuffle partitions.

    Rows that repeat their texts take some fortieth of their memory in a shuffle, and Spark joins small
    partitions by their bytes there: one task could then hold most of a table. These are not joined.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side of an equi join that grows with the input: its bytes in files and shuffles tell too little of its memory to broadcast it by."""
    return df.hint("merge")


def opening_sums(
    df: DataFrame, keys: Sequence[str], blk: str, sums: dict[str, Column]
) -> DataFrame:
    """One row per (group, block) with the sums of all earlier blocks.

    Blocks without earlier ones get no row.
    """
    totals = df.groupBy(*keys, blk).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = before(*keys, order=[blk])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(blk))
    return (
        totals.select(*keys, blk, *[F.sum(n).over(w).alias(n) for n in sums], first.alias("_block_no"))
        .filter("_block_no > 1")
        .drop("_block_no")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    order: Sequence[str],
    sums: dict[str, Column],
    block: int = BLOCK,
    slim: bool = False,
) -> DataFrame:
    """Add inclusive running sums (bigint) per ``keys`` in ``order``.

    ``slim``: the rows are many and hold little but numbers, see ``spread``.

    ``pos`` is a non-negative whole-number column and the leading order column;
    a group may hold any number of rows, a single position only a bounded one.
    """
    added = {n: F.coalesce(c.cast("bigint"), F.lit(0)) for n, c in sums.items()}
    rows = df.withColumn("_blk", block_of(pos, block))
    opening = opening_sums(rows, keys, "_blk", added)
    body = rows.withColumns(added).withColumn("_open", F.lit(False))
    both = body.unionByName(opening.withColumn("_open", F.lit(True)), allowMissingColumns=True)
    both = spread(both, *keys, "_blk") if slim else both
    w = so_far(*keys, "_blk", order=[F.col("_open").desc(), *order])
    return (
        both.withColumns({n: F.sum(n).over(w) for n in sums})
        .filter(~F.col("_open"))
        .drop("_open", "_blk")
    )
