"""Document features on streams. The reference has no streams; its per-document operators run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.functions import checks as C
from braidwork.functions import text as T


def enrich(stream: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, cleaned text, skills, guessed language, grammar score and issue count of each arriving document."""
    c = F.col(text)
    return stream.select(key, T.clean(c).alias("cleaned"), T.tech_skills(c).alias("skills"), T.guess_language(c).alias("lang"), C.grammar(c)["score"].alias("grammar_score"), F.size(C.all_checks(c)).alias("n_issues"))


def latest_only(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows once within the watermark: rows delivered again are dropped, with state bounded by ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window of event time and value of ``by``; windows close when the watermark passes them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def score_against(stream: DataFrame, vacancies: DataFrame, most: int = 100_000) -> DataFrame:
    """Stream-static join: each resume with the vacancies that share a skill with it, and the share of theirs it has.

    The static side is broadcast only if it has at most ``most`` rows.
    """
    v = vacancies.select("vacancy_id", F.size("skills").alias("n_skills"), F.explode("skills").alias("skill"))
    side = F.broadcast(v) if v.limit(most + 1).count() <= most else v
    return stream.select("cv_id", F.explode("skills").alias("skill")).join(side, "skill").select("cv_id", "vacancy_id", "skill", (1 / F.col("n_skills")).alias("share"))


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended to a Parquet table exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
