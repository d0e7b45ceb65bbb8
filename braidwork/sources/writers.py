"""Sinks: texts, JSON, CSV, Parquet, ranking results, run summaries and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_text(df: DataFrame, path: str, text: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_table(df: DataFrame, path: str) -> None:
    """Columnar, in place of pickled objects."""
    df.write.mode("overwrite").parquet(path)


def save_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_processed(df: DataFrame, folder: str, key: str, text: str) -> None:
    """Cleaned texts by id and full records as JSON."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(f"{folder}/cleaned")
    save_json(df, f"{folder}/full")


def wide_rankings(ranks: DataFrame, key: str = "cv_id", item: str = "vacancy_id", rank: str = "rank", items: list[int] | None = None) -> DataFrame:
    """``key, rankings, rank_vac<i>``: one row per CV; a missing rank is 0."""
    items = items or [1, 2, 3, 4, 5]
    wide = ranks.groupBy(key).pivot(item, items).agg(F.first(rank))
    columns = [F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"rank_vac{i}") for i in items]
    wide = wide.select(key, *columns)
    return wide.select(key, F.to_json(F.array(*[f"rank_vac{i}" for i in items])).alias("rankings"), *[f"rank_vac{i}" for i in items])


def save_rankings(ranks: DataFrame, folder: str, method: str, stamp: str, **names) -> str:
    path = f"{folder}/rankings_{method}_{stamp}.csv"
    save_csv(wide_rankings(ranks, **names), path, one_file=True)
    return path


def run_summary(cvs: DataFrame, vacancies: DataFrame, stamp: str) -> DataFrame:
    """One row: how many CVs and vacancies, their lowest and highest ids, and a stamp."""
    c = cvs.agg(F.count_distinct("cv_id").alias("num_cvs"), F.min("cv_id").alias("first_cv"), F.max("cv_id").alias("last_cv"))
    one = lambda aggregate, name: vacancies.agg(aggregate).scalar().alias(name)
    return c.select("*", one(F.count_distinct("vacancy_id"), "num_vacancies"), one(F.min("vacancy_id"), "first_vacancy"), one(F.max("vacancy_id"), "last_vacancy"), F.lit(stamp).alias("stamp"))


def report(metrics: DataFrame, cvs: int, vacancies: int, most: int = 1000) -> str:
    """A Markdown report of the methods by alpha, best first; ``most`` rows at most are read by the driver."""
    rows = metrics.orderBy(F.desc("alpha")).limit(most).collect()
    lines = ["# Ranking report", "", f"- resumes: {cvs}", f"- vacancies: {vacancies}", "", "| method | alpha | rho | accuracy@1 | NDCG@5 |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r['method']} | {r['alpha']:.4f} | {r['rho']:.4f} | {r['accuracy_1']:.4f} | {r['ndcg_5']:.4f} |" for r in rows]
    if rows:
        lines += ["", f"Best method: {rows[0]['method']}"]
    return "\n".join(lines) + "\n"
