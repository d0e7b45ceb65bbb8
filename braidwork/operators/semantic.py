"""Similarity of vectors, BM25, and distances of sparse n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.terms import char_ngrams
from braidwork.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_unit(unit: Column, other: Column) -> Column:
    """Cosine with a first vector of length 1."""
    return dot(unit, other) / F.sqrt(dot(other, other))


def distance(a: Column, b: Column, metric: str = "l1") -> Column:
    """``l1``, ``l2`` or ``cosine`` distance; a zero vector has cosine distance 1; an unknown name means ``l1``."""
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame) -> DataFrame:
    """``c_label, c``: the mean vector of each label, by pre-aggregated sums per dimension."""
    means = vectors.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy(F.col("label").alias("c_label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))


def against_centroids(vectors: DataFrame, most: int = 10_000) -> DataFrame:
    """``vec_id, label, c_label, sim`` of every vector against every centroid, a stated set of at most ``most``.

    Each row carries the centroids as an array and is compared with them in place: no row is joined with another.
    """
    rows = centroids(vectors).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    table = vectors.sparkSession.createDataFrame([(sorted((r["c_label"], list(r["c"])) for r in rows),)], "cs array<struct<c_label:int,c:array<double>>>")
    return vectors.join(F.broadcast(table)).select("vec_id", "label", "e", F.inline("cs")).select("vec_id", "label", "c_label", cosine_unit(F.col("e"), F.col("c")).alias("sim"))


def bm25(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """``cv_id, vacancy_id, bm25`` of ``pairs``, from ``cv_id, tokens`` and ``vacancy_id, tokens``.

    Okapi weights with ``idf = ln(N - df + 0.5) - ln(df + 0.5)``, a negative one replaced by ``eps`` times the mean of
    all; a query word counts as often as it occurs.
    """
    q = queries.select("cv_id", F.explode("tokens").alias("term")).groupBy("cv_id", "term").agg(F.count("*").alias("qtf"))
    d = materialize(corpus.select("vacancy_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("vacancy_id", "dl", "term").agg(F.count("*").alias("tf")), "terms")
    n, avgdl = corpus.agg(F.count("*").alias("n")).scalar(), corpus.agg(F.avg(F.size("tokens")).alias("avgdl")).scalar()
    raw = d.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean")).scalar()
    idf = raw.select("term", F.when(F.col("idf") < 0, eps * mean).otherwise(F.col("idf")).alias("idf"), avgdl.alias("avgdl"))
    d = d.join(idf, "term").withColumn("w", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).select("vacancy_id", "term", "w")
    s = pairs.join(q, "cv_id").join(d, ["vacancy_id", "term"]).groupBy("cv_id", "vacancy_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("bm25"))
    return pairs.join(s, ["cv_id", "vacancy_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def gram_vectors(texts: DataFrame, key: str) -> DataFrame:
    """``key, term, w, pos``: L2-normalised character n-gram counts of the key's own text, with alphabetical positions."""
    c = texts.select(key, F.explode(char_ngrams(F.col(key))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("n"))
    own = Window.partitionBy(key)
    return c.select(key, "term", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(own))).alias("w"), F.row_number().over(own.orderBy("term")).alias("pos"))


def l1_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: str = "term") -> DataFrame:
    """Adds ``l1`` of non-negative sparse vectors: both sums less twice the common minimum, so an inner join suffices."""
    sums = lambda d, key, name: d.groupBy(key).agg(F.sum("w").alias(name))
    both = pairs.join(left.select(left_key, on, F.col("w").alias("__a")), left_key).join(right.select(right_key, on, F.col("w").alias("__b")), [right_key, on])
    common = both.groupBy(left_key, right_key).agg(F.sum(F.least("__a", "__b")).alias("__m"))
    d = pairs.join(sums(left, left_key, "__x"), left_key).join(sums(right, right_key, "__y"), right_key).join(common, [left_key, right_key], "left")
    return d.withColumn("l1", F.greatest(F.lit(0.0), F.col("__x") + F.col("__y") - 2 * F.coalesce("__m", F.lit(0.0)))).drop("__x", "__y", "__m")


def hashed_encoder(dim: int = 256):
    """A stand-in for a sentence encoder: hashed word and character trigram counts, L2-normalised. No transformer."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), dtype="float32")
        for i, t in enumerate(texts):
            low = " ".join((t or "").lower().split())
            for g in (*low.split(), *(low[j : j + 3] for j in range(max(0, len(low) - 2)))):
                h = xxhash.xxh32_intdigest(g)
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(out[i])
            out[i] /= n if n else 1.0
        return out

    return encode


def encode(text: Column, encoder=None) -> Column:
    """``array<float>`` of each text by an encoder ``list[str] -> matrix``, applied to Arrow batches."""
    encoder = encoder or hashed_encoder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder(texts.tolist())))

    return run(text)
