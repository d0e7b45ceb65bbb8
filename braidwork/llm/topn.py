"""Top N items within every group, by per-group score histograms (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import materialize


def latest_scores(df: DataFrame, keys: Sequence[str], score: str, newest: Sequence[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """One row per ``keys``: the score of its newest row, by ``newest`` in descending order.

    Rows whose score is null, NaN or outside ``low``..``high``, or with a null key, do not count. A null in
    ``newest`` is older than any value. Repeated rows have no effect. Columns: ``keys`` and ``score``.
    """
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(score).between(low, high)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.where(ok).groupBy(*keys).agg(F.max(F.struct(*newest, score)).alias("__newest")).select(*keys, F.col(f"__newest.{score}").alias(score))


def hot_groups(counts: DataFrame, share: int = 2000, copies: int = 64) -> DataFrame:
    """``(__g, __salts)`` of the groups that hold at least one ``share``-th of all rows: ``share`` groups at most, so
    they can be broadcast whatever the number of groups is. A group gets a salt for each such part, at most ``copies``.

    ``counts``: ``(__g, __n)`` rows, any number for a group.
    """
    sums = counts.groupBy("__g").agg(F.sum("__n").alias("__n"))
    part = F.ceil(F.col("__all") / share)
    total = counts.agg(F.sum("__n").alias("__all"))
    return sums.join(F.broadcast(total), F.col("__n") * share >= F.col("__all")).select("__g", F.least(F.lit(copies), F.ceil(F.col("__n") / part) + 1).cast("int").alias("__salts"))


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int, low: float = 0.0, high: float = 100.0, bins: int = 200) -> DataFrame:
    """The ``n`` rows of highest ``score`` of every group, ties by ``ties`` ascending; ``place`` counts from 1.

    A histogram of ``bins`` classes per group gives the highest class at and above which the group has at
    least ``n`` rows (the lowest class if it has fewer). Rows below are filtered before the exact ranking, so a
    group of any size brings little more than ``n`` rows into it; of rows that tie in the class, each partition
    keeps only its ``n`` best before they meet, since the rank is bounded. The thresholds meet the rows in a join on
    group and salt: a hot group is spread over many tasks, a group of its own size in none.

    Rows with a null group, or a null or NaN score, have no place. Scores outside ``low``..``high`` fall in the
    outer classes, so any range gives right results. Repeated rows are rows. An empty table gives an empty one.
    Columns: group, score, ties, place (int).
    """
    ties = [t for t in ties if t not in (group, score)]
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(group, score, *ties)
    rows = materialize(rows, "scores")  # read for the histogram and for the ranking
    cls = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(score) - low) * (bins / (high - low))))).cast("int")
    counts = materialize(rows.groupBy(F.col(group).alias("__g"), cls.alias("__cls")).agg(F.count("*").alias("__n")), "histogram")
    above = Window.partitionBy("__g").orderBy(F.desc("__cls")).rowsBetween(Window.unboundedPreceding, -1)
    floor = counts.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).where(F.col("__above") < n).groupBy("__g").agg(F.min("__cls").alias("__floor"))
    hot = F.broadcast(materialize(hot_groups(counts), "hot"))
    floors = floor.join(hot, "__g", "left").select("__g", "__floor", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt"))
    salted = rows.join(hot, F.col(group) == F.col("__g"), "left").withColumn("__salt", F.pmod(F.xxhash64(score, *ties), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__g", "__salts")
    kept = salted.join(floors, (F.col(group) == F.col("__g")) & (salted["__salt"] == floors["__salt"])).where(cls >= F.col("__floor")).select(group, score, *ties)
    best = Window.partitionBy(group).orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def best_vacancies(match_results: DataFrame, n: int = 3) -> DataFrame:
    """``cv_id, place, vacancy_id``: each CV's ``n`` best vacancies by their latest counting scores."""
    scores = latest_scores(match_results, ["cv_id", "vacancy_id"], "total_score", ["scored_at", "result_id"])
    return top_n(scores, "cv_id", "total_score", ["vacancy_id"], n).select("cv_id", "place", "vacancy_id")
