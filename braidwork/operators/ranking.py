"""Ranks within groups of any size, and scores that depend on a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_groups(df: DataFrame, group: str, score: str, ties: Sequence[Column | str], out: str = "rank", descending: bool = True, low: float = 0.0, high: float = 100.0, bins: int = 100) -> DataFrame:
    """Adds ``out``: 1 for the best ``score`` of the group, ties by ``ties``.

    A group is cut into ``bins`` classes of the score; a row's rank is the number of rows in better classes plus
    its rank in its class. So a group with a third of all rows is ranked by many tasks, and only the classes' counts
    go through a window over the group. Scores outside ``low``..``high`` fall in the outer classes.
    """
    cls = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(score) - low) * (bins / (high - low))))).cast("int")
    cut = df.withColumn("__cls", (F.lit(bins - 1) - cls) if descending else cls)
    counts = cut.groupBy(group, "__cls").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__cls").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias("__g"), F.col("__cls").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, "__cls").orderBy(F.desc(score) if descending else F.asc(score), *ties)
    joined = cut.join(bases, (F.col(group) == F.col("__g")) & (F.col("__cls") == F.col("__c")))
    return joined.withColumn(out, (F.col("__base") + F.row_number().over(inside)).cast("int")).drop("__cls", "__g", "__c", "__base")


def with_stats(df: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """Adds aggregates over the group: pre-aggregated and joined, so that no task holds a whole group."""
    stats = df.groupBy(F.col(group).alias("__g")).agg(*aggregates)
    return df.join(stats, F.col(group) == F.col("__g")).drop("__g")


def minmax(df: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """Adds ``out``: the score scaled to 0..1 over the group; 0.5 if all are equal."""
    d = with_stats(df, group, F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return d.withColumn(out, F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.5))).drop("__lo", "__hi")


def ensemble(df: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Adds ``ensemble`` from ``total_score``, the min-maxed ``tfidf_score`` and ``semantic_score``, times 100."""
    d = minmax(df, "cv_id", "tfidf_score", "__vm")
    u, v, b = weights
    return d.withColumn("ensemble", 100 * (u * F.col("total_score") / 100 + v * F.col("__vm") + b * F.col("semantic_score") / 100)).drop("__vm")


def bidirectional(df: DataFrame, forward: str = "ensemble", share: float = 0.6) -> DataFrame:
    """Adds ``position`` of the CV among the vacancy's candidates by ``total_score``, ``backward = 100 / position`` and
    ``bidirectional``, ``share`` forward and the rest backward."""
    d = rank_in_groups(df, "vacancy_id", "total_score", ["cv_id"], out="position")
    d = d.withColumn("backward", 100 / F.col("position"))
    return d.withColumn("bidirectional", share * F.col(forward) + (1 - share) * F.col("backward"))


def competition(df: DataFrame) -> DataFrame:
    """Adds ``competition``: the two-way score, 15 % less beyond mean + 1.5 deviations of the vacancy's scores, 10 %
    more in the first fifth of its candidates."""
    d = with_stats(df, "vacancy_id", F.avg("total_score").alias("__m"), F.stddev_pop("total_score").alias("__s"), F.count("*").alias("__n"))
    over = F.when(F.col("bidirectional") > F.col("__m") + 1.5 * F.col("__s"), 0.85).otherwise(1.0)
    top = F.when(F.col("position") <= F.floor(0.2 * F.col("__n")), 1.1).otherwise(1.0)
    return d.withColumn("competition", F.col("bidirectional") * over * top).drop("__m", "__s", "__n")
