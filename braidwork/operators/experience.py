"""Work periods as rows: unions of intervals by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import text as T


def period_rows(docs: DataFrame, key: str, periods: Column) -> DataFrame:
    """``key, start, end``, each distinct period of a record once."""
    return docs.select(key, F.inline(periods)).distinct()


def islands(rows: DataFrame, key: str, tolerance: int = 0) -> DataFrame:
    """Adds ``reached`` (the latest end before the row), ``new`` (1 if the row starts an island) and ``island``.

    Rows are in order of start and end; a row joins the island if it starts by ``tolerance`` after the latest end.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("reached", F.max("end").over(before))
    d = d.withColumn("new", F.when(F.col("reached").isNull() | (F.col("start") > F.col("reached") + tolerance), 1).otherwise(0))
    return d.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def union_years(rows: DataFrame, key: str, tolerance: int = 0) -> DataFrame:
    """``key, n_islands, years``: years from each island's first start to its latest end, summed. Reversed periods count
    negatively, as they stand."""
    first = F.min_by("start", F.struct("start", "end"))
    per = islands(rows, key, tolerance).groupBy(key, "island").agg((F.max("end") - first).alias("y"))
    return per.groupBy(key).agg(F.count("*").alias("n_islands"), F.sum("y").cast("double").alias("years"))


#: A period of work in any text. A fixed value.
CONTEXT_PERIOD = r"(?i)(\d{4})\s*[-–—]\s*(\d{4}|now|present|current)"


def context_periods(docs: DataFrame, key: str, text: str, as_of: int = 2026, reach: int = 50) -> DataFrame:
    """``key, start, end`` of ``YYYY - YYYY|now|present|current`` with neither education nor university within ``reach``
    characters before or after.

    The text's matches and what lies between them give each match's place.
    """
    d = docs.select(key, F.col(text).alias("__t"), F.regexp_extract_all(text, F.lit(CONTEXT_PERIOD), F.lit(0)).alias("__m"), F.split(text, CONTEXT_PERIOD).alias("__gap"))
    d = d.select(key, "__t", "__m", "__gap", F.posexplode("__m").alias("__i", "__x"))
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    d = d.withColumn("__at", length(F.slice("__gap", 1, F.col("__i") + 1)) + length(F.slice("__m", 1, F.col("__i"))))
    first = F.greatest(F.lit(0), F.col("__at") - reach)
    around = F.lower(F.col("__t").substr(first + 1, F.col("__at") - first + F.length("__x") + reach))
    end = F.regexp_extract("__x", CONTEXT_PERIOD, 2)
    kept = d.where(~around.contains("education") & ~around.contains("university"))
    return kept.select(key, F.regexp_extract("__x", CONTEXT_PERIOD, 1).cast("int").alias("start"), F.when(end.rlike(r"^\d+$"), end.cast("int")).otherwise(F.lit(as_of)).alias("end")).distinct()


def mention_periods(docs: DataFrame, key: str, text: str, pattern: str, as_of: int = 2026) -> DataFrame:
    """``key, start, end`` of neighbouring date mentions with a dash or ``to`` between them, start before end.

    Mentions and what lies between them come from one split of the text, so offsets are not needed.
    """
    d = docs.select(key, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("gap"))
    rows = d.select(key, "gap", F.posexplode("m").alias("i", "mention"))
    w = Window.partitionBy(key).orderBy("i")
    closed = F.col("mention").rlike(r"\d{4}")
    rows = rows.withColumn("closed", closed).withColumn("year", F.when(closed, F.regexp_extract("mention", r"(\d{4})", 1).cast("int")).otherwise(F.lit(as_of)))
    rows = rows.withColumn("next", F.lead("year").over(w)).withColumn("between", T.strip(F.get("gap", F.col("i") + 1)))
    return rows.where(F.col("closed") & F.col("between").isin("-", "–", "—", "to") & (F.col("year") < F.col("next"))).select(key, F.col("year").alias("start"), F.col("next").alias("end")).distinct()


def choose(regex_years: Column, periods: Column) -> tuple[Column, Column]:
    """Years and method: the regex value, or, if it is 0 and periods were mentioned, their unmerged sum."""
    mentioned = F.aggregate(periods, F.lit(0), lambda s, p: s + p["end"] - p["start"])
    use = (regex_years == 0) & (F.size(periods) > 0)
    return F.when(use, mentioned.cast("double")).otherwise(regex_years), F.when(use, F.lit("ner")).otherwise(F.lit("regex"))
