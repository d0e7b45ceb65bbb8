"""Terms of documents: keywords, n-grams, vocabularies and TF-IDF vectors as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.lexicons import CATEGORIES, KEYWORD_STOP_WORDS, STOP_WORDS
from braidwork.functions.text import category_skills, let


def top_keywords(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """``key, keyword, n, place``: the most frequent words of three or more Latin letters, first seen first at ties."""
    w = docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("i", "keyword"))
    w = w.where(F.col("keyword").rlike("^[a-z]{3,}$") & ~F.col("keyword").isin(*KEYWORD_STOP_WORDS))
    counts = w.groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min("i").alias("__first"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "__first")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select(key, "keyword", "n", "place")


def char_ngrams(text: Column, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """All character n-grams of the lower-cased text, white-space runs as one blank.

    The text is cut into characters once; longer n-grams are joined from shifted slices, in time linear in the text.
    """
    chars = F.filter(F.split(F.regexp_replace(F.lower(text), r"\s\s+", " "), ""), lambda c: c != "")
    return let(chars, lambda c: F.concat(*[_shifted(c, n, "") for n in sizes]))


def _shifted(items: Column, n: int, glue: str) -> Column:
    """All runs of ``n`` neighbouring items, joined."""
    length = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, 1, length)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, 1 + k, length), lambda a, b: F.concat_ws(glue, a, b))
    return out


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))


def word_ngrams(text: Column, most: int = 2) -> Column:
    """Word n-grams of 1 to ``most`` words, after stop words are removed."""
    return let(tokens(text), lambda w: F.concat(*[_shifted(w, n, " ") for n in range(1, most + 1)]))


def term_counts(docs: DataFrame, keys: Sequence[str], grams: Column) -> DataFrame:
    """``keys, term, tf``."""
    return docs.select(*keys, F.explode(grams).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, most: int) -> DataFrame:
    """``term, corpus_tf, df``: the ``most`` most frequent terms of the corpus, ties by term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.count("*").alias("df")).orderBy(F.desc("corpus_tf"), "term").limit(most)


def tfidf(counts: DataFrame, keys: Sequence[str], n_docs: int, vocab: DataFrame | None = None, sublinear: bool = True) -> DataFrame:
    """``keys, term, w``: L2-normalised ``tf * idf`` with ``idf = ln((1 + N) / (1 + df)) + 1``.

    The vocabulary is broadcast: it is limited when it is made.
    """
    v = vocab if vocab is not None else counts.groupBy("term").agg(F.count("*").alias("df"))
    v = v.select("term", "df")
    t = counts.join(F.broadcast(v) if vocab is not None else v, "term")
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = t.withColumn("w", tf * (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norm = Window.partitionBy(*keys)
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).select(*keys, "term", "w")


def top_terms(weights: DataFrame, key: str, n: int = 10) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.desc(F.round("w", 9)), "term")
    return weights.where(F.col("w") > 0).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def term_map(weights: DataFrame, keys: Sequence[str], n: int = 20, digits: int = 4) -> DataFrame:
    """``keys, terms``: a document's ``n`` terms of highest weight as a map from term to weight, best first."""
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("w", 9)), "term")
    top = weights.where(F.col("w") > 0).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "term", F.round("w", digits).alias("w")))).alias("p"))
    return rows.select(*keys, F.map_from_entries(F.transform("p", lambda x: F.struct(x["term"], x["w"]))).alias("terms"))


def extract_skills(docs: DataFrame, weights: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """``key, skills``: one struct of a document's ``n`` key phrases (``phrases``) and its terms of every category.

    ``weights``: ``key, term, w``. A document without a weighted term has no phrases.
    """
    phrases = term_map(weights, [key], n).select(key, F.map_keys("terms").alias("phrases"))
    every = [category_skills(F.col(text), c).alias(c) for c in CATEGORIES]
    found = docs.join(phrases, key, "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    return found.select(key, F.struct("phrases", *every).alias("skills"))


def pair_dot(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Dot product of two sparse vectors for every given pair; pairs without a common term have 0.

    The left vectors are joined to the pairs first, then the right ones on key and term: what is shuffled grows
    with pairs times terms of a vector, never with all pairs.
    """
    both = pairs.join(left.select(left_key, "term", F.col("w").alias("__a")), left_key).join(right.select(right_key, "term", F.col("w").alias("__b")), [right_key, "term"])
    dots = both.groupBy(left_key, right_key).agg(F.sum(F.col("__a") * F.col("__b")).alias("dot"))
    return pairs.join(dots, [left_key, right_key], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
