"""Rankings given as ballots: which ones count, and their consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counting_ballots(annotations: DataFrame, size: int = 5) -> DataFrame:
    """``cv_id, annotator, vacancy_id, rank_no`` of the ballots that count.

    A ballot is valid if its distinct rows rank ``size`` different vacancies with 1 to ``size``, each once; a null
    or foreign rank or a null vacancy makes it invalid. Of an annotator's valid ballots for a CV, the latest
    ``annotated_at`` counts (null is oldest), then the highest ``ballot_id``. Rows without ballot, annotator or
    CV are dropped; repeated rows count once.
    """
    rows = annotations.where(F.col("ballot_id").isNotNull() & F.col("annotator").isNotNull() & F.col("cv_id").isNotNull()).select("ballot_id", "annotator", "cv_id", "vacancy_id", "rank_no", "annotated_at").distinct()
    good = F.col("rank_no").between(1, size) & F.col("vacancy_id").isNotNull()
    bit = F.when(good, F.pow(F.lit(2), F.col("rank_no")).cast("long"))
    ballots = (
        rows.groupBy("cv_id", "annotator", "ballot_id")
        .agg(F.count("*").alias("n"), F.count(bit).alias("n_good"), F.bit_or(bit).alias("ranks"), F.max("annotated_at").alias("at"), F.count_distinct("vacancy_id").alias("n_vacancies"))
        .where((F.col("n") == size) & (F.col("n_good") == size) & (F.col("ranks") == 2 ** (size + 1) - 2) & (F.col("n_vacancies") == size))
    )
    newest = ballots.groupBy("cv_id", "annotator").agg(F.max(F.struct("at", "ballot_id"))["ballot_id"].alias("ballot_id"))
    return rows.select("cv_id", "annotator", "ballot_id", "vacancy_id", "rank_no").join(newest, ["cv_id", "annotator", "ballot_id"], "left_semi").drop("ballot_id")


def consensus(votes: DataFrame, least_annotators: int = 2) -> DataFrame:
    """``cv_id, vacancy_id, mean_rank, rank``: by mean rank, at equal means the higher vacancy first."""
    several = votes.groupBy("cv_id").agg(F.count_distinct("annotator").alias("n")).where(F.col("n") >= least_annotators)
    means = votes.join(several, "cv_id", "left_semi").groupBy("cv_id", "vacancy_id").agg(F.avg("rank_no").alias("mean_rank"))
    order = Window.partitionBy("cv_id").orderBy("mean_rank", F.desc("vacancy_id"))
    return means.withColumn("rank", F.row_number().over(order))


def valid_lists(ranks: str | F.Column, size: int = 5) -> F.Column:
    """Whether an array is a permutation of 1 to ``size``; null arrays are not."""
    return F.coalesce(F.array_sort(ranks) == F.sequence(F.lit(1), F.lit(size)), F.lit(False))
