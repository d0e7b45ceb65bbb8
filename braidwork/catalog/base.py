"""Registration of queries, and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.catalog import ORACLE, QUERIES
from braidwork.session import table


def query(sql: str | None = None) -> Callable:
    """Registers a function ``(tables) -> DataFrame`` under its name, with its SQL if it has any."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of a folder; ``cv`` and ``vac`` are the texts, each record once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def cv(self) -> DataFrame:
        return self.cv_data.where("text IS NOT NULL").select("cv_id", "text").distinct()

    @property
    def vac(self) -> DataFrame:
        return self.vacancies.where("job_description IS NOT NULL").select("vacancy_id", "job_title", "job_description").distinct()


CV = "(SELECT DISTINCT cv_id, text FROM cv_data WHERE text IS NOT NULL)"
VAC = "(SELECT DISTINCT vacancy_id, job_title, job_description FROM vacancies WHERE job_description IS NOT NULL)"


def lit(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda x: x <> '')"


def has_word_sql(x: str, names) -> str:
    alternatives = "|".join("".join("\\" + c if not c.isalnum() and c not in " _" else c for c in n) for n in names)
    return f"regexp_matches(lower({x}), {lit(rf'(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])')})"


def first_section_sql(x: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(p)}) THEN {strip_sql(f'regexp_extract({x}, {lit(p)}, 1)')}" for p in patterns) + " ELSE '' END"


def count_sql(conditions) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"


def listed_sql(cases) -> str:
    """The cases ``(condition, text)`` that hold, joined by commas."""
    return "concat_ws(','" + "".join(f", CASE WHEN {c} THEN {t} END" for c, t in cases) + ")"


def rnd(c, n: int):
    """Rounded half up in binary, the same in both engines; ``round`` differs at ties."""
    return F.floor(c * F.lit(10.0**n) + F.lit(0.5)) / F.lit(10.0**n)


def rnd_sql(x: str, n: int) -> str:
    return f"floor(({x}) * {10.0**n:.1f}::DOUBLE + 0.5::DOUBLE) / {10.0**n:.1f}::DOUBLE"


__all__ = ["rnd", "rnd_sql", "CV", "VAC", "F", "Tables", "count_sql", "first_section_sql", "has_word_sql", "listed_sql", "lit", "query", "strip_sql", "words_sql"]
