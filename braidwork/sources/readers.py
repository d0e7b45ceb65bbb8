"""Sources: word-processor documents, quoted multi-line CSV, results written earlier."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VACANCY_SCHEMA = "id int, job_description string, job_title string, uid string"
_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Non-blank paragraphs of the document's body, joined by line breaks; None if it cannot be read. Tables, headers
    and footers are not read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
        lines = []
        for p in body.findall(f"{_NS}p"):
            parts = {f"{_NS}t": lambda e: e.text or "", f"{_NS}tab": lambda e: "\t", f"{_NS}br": lambda e: "\n"}
            lines.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
        return "\n".join(x for x in lines if x.strip())
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return None


def read_resumes(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """``cv_id, raw_text`` of ``<number>.docx`` files by number; unreadable and empty documents are dropped.

    Files are read and parsed by the tasks, in batches; ``limit`` keeps the documents with the lowest numbers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    files = files.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).try_cast("int").alias("cv_id"), "content").where(F.col("cv_id").isNotNull())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cv_id": b["cv_id"], "raw_text": [docx_text(c) for c in b["content"]]})

    docs = files.mapInPandas(parse, "cv_id int, raw_text string").where(F.length(F.trim("raw_text")) > 0)
    return docs.orderBy("cv_id").limit(limit) if limit is not None else docs


def read_vacancies(spark: SparkSession, path: str) -> DataFrame:
    """The vacancies CSV with ``vacancy_id`` from 1 in file order."""
    df = spark.read.schema(VACANCY_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return with_row_numbers(df, "vacancy_id")


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """Adds consecutive numbers from 1 in the order of partitions and of rows within them.

    Only the partitions' sizes go through a window over all; rows are numbered where they lie.
    """
    d = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    sizes = d.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return d.join(F.broadcast(bases), "__p").withColumn(name, (F.col("__base") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("__m", "__p", "__base")


def by_id(df: DataFrame, key: str, value: int) -> DataFrame:
    """The row of one id, or none."""
    return df.where(F.col(key) == value)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files below a folder, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def read_rankings(spark: SparkSession, pattern: str) -> DataFrame:
    """``method, cv_id, rankings`` of ``rankings_<method>_<time>.csv`` results; lists are parsed as JSON, never evaluated."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(pattern).select(F.col("cv_id").cast("int").alias("cv_id"), "rankings", F.col("_metadata.file_path").alias("__path"))
    name = F.regexp_extract("__path", r"rankings_([A-Za-z0-9_]+?)(?:_\d{8}_\d{6})?\.csv", 1)
    return raw.select(name.alias("method"), "cv_id", F.from_json("rankings", "array<int>").alias("rankings"))
