"""The pair table: one row per scored pair of CV and vacancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("keyword_score", "tfidf_score", "semantic_score", "total_score")


def latest_pairs(match_results: DataFrame) -> DataFrame:
    """``cv_id, vacancy_id`` and the four scores of each pair's newest row whose scores are all within 0..100."""
    ok = F.col("cv_id").isNotNull() & F.col("vacancy_id").isNotNull()
    for s in SCORES:
        ok = ok & F.col(s).isNotNull() & ~F.isnan(s) & F.col(s).between(0, 100)
    newest = match_results.where(ok).groupBy("cv_id", "vacancy_id").agg(F.max(F.struct("scored_at", "result_id", *SCORES)).alias("r"))
    return newest.select("cv_id", "vacancy_id", *[F.col(f"r.{s}").alias(s) for s in SCORES])


def scored_pairs(match_results: DataFrame) -> DataFrame:
    """The distinct pairs that were ever scored: the candidates for scoring again."""
    return match_results.where(F.col("cv_id").isNotNull() & F.col("vacancy_id").isNotNull()).select("cv_id", "vacancy_id").distinct()


def unified(df: DataFrame, weights: tuple[float, float, float] = (0.60, 0.25, 0.15)) -> DataFrame:
    """Adds ``unified``: the weighted sum of keyword, TF-IDF and semantic score, to one digit."""
    k, t, s = weights
    raw = k * F.col("keyword_score") + t * F.col("tfidf_score") + s * F.col("semantic_score")
    return df.withColumn("unified", F.floor(raw * 10 + 0.5) / 10)
