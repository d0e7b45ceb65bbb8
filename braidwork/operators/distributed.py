"""Prefix sums and row numbers over groups of any size, without one task per group.

A group is cut into blocks by a hash of its order key, so that no task sees more than a block; only the
blocks' totals go through a window over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_for(rows: int, per_block: int = 200_000, least: int = 16) -> int:
    """Blocks so that a block has about ``per_block`` rows."""
    return max(least, -(-rows // per_block))


def blocked_prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, blocks: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before the row.

    ``order[0]`` must be a bigint spread evenly over its range (a hash); the rest breaks ties and must make
    the order total. Nulls in ``value`` count as 0. An empty table stays empty.
    """
    bits = max(1, (blocks - 1).bit_length())
    cut = df.withColumn("__block", F.shiftright(F.col(order[0]), 64 - bits).cast("int"))
    v = F.coalesce(F.col(value), F.lit(0))
    sums = cut.groupBy(*group, "__block").agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    on: Column = F.col("__block") == F.col("__b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(bases, on)
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
        .drop("__block", "__b", "__base", *[f"__g{i}" for i in range(len(group))])
    )
