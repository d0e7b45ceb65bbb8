"""The grid of text types and representations that rank vacancies by the L1 distance of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import lexicons as X
from braidwork.functions import text as T
from braidwork.operators import semantic as S
from braidwork.operators import terms as G
from braidwork.session import materialize

TYPES = ("full", "summary", "kw_summary", "ne_summary")
RANGES = ((1, 2), (1, 3), (2, 3))
#: Representation and n-gram range; the last three have no range.
REPRESENTATIONS = (*((r, f"{lo}-{hi}") for r in ("char_ngrams", "word_ngrams") for lo, hi in RANGES), ("tfidf", ""), ("encoder", ""), ("all", ""))


def text_types(docs: DataFrame) -> DataFrame:
    """``side, id, kind, text`` of ``side, id, text``: the text, its summary, and that with keywords or entities after it."""
    top = G.top_keywords(docs.withColumn("__key", F.struct("side", "id")), "__key", "text", 10)
    top = top.groupBy("__key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), " ").alias("kw")).select("__key.*", "kw")
    entities = F.filter(F.slice(F.regexp_extract_all("text", F.lit(X.ENTITY), F.lit(1)), 1, 20), lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*X.KEYWORD_STOP_WORDS))
    short = T.raw_summary(F.col("text"))
    forms = (F.col("text"), short, F.concat_ws(" ", short, F.coalesce("kw", F.lit(""))), F.concat_ws(" ", short, F.array_join(F.slice(entities, 1, 10), " ")))
    return docs.join(top, ["side", "id"], "left").select("side", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("text")) for k, f in zip(TYPES, forms)])).alias("x")).select("side", "id", "x.*")


def features(typed: DataFrame, n_docs: int) -> DataFrame:
    """``side, id, kind, chars, words, terms, w, e``: each text type's characters, hashed words, TF-IDF vector (fitted on
    all types of both sides) and encoding, once for all configurations."""
    keys = ["side", "id", "kind"]
    w = G.tfidf(G.term_counts(typed, keys, G.word_ngrams(F.col("text"))), keys, n_docs, sublinear=False)
    w = w.groupBy(*keys).agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), F.col("w").cast("float").alias("w"))).alias("v"))
    chars = F.regexp_replace(F.lower("text"), r"\s\s+", " ")
    d = typed.select(*keys, chars.alias("chars"), F.transform(G.tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("words"), S.encode(F.substring("text", 1, 1000)).alias("e"))
    return d.join(w, keys, "left").select(*keys, "chars", "words", F.col("v.term").alias("terms"), F.col("v.w").alias("w"), "e")


def _matrix(ids: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """One row a document, one column for each different id: its weights' sum, or how often it occurs."""
    known, place = np.unique(np.concatenate(ids), return_inverse=True)
    own = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    return np.bincount(own * len(known) + place, None if weights is None else np.concatenate(weights), len(ids) * len(known)).reshape(len(ids), len(known)).astype(float)


def _grams(items: list[np.ndarray], n: int) -> np.ndarray:
    """Counts of the runs of ``n`` items, which are numbers below 2**21."""
    return _matrix([sum((x[j : max(0, len(x) - n + 1) + j] << np.int64(21 * j) for j in range(n)), np.zeros(max(0, len(x) - n + 1), "int64")) for x in items])


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _array(x, kind: str) -> np.ndarray:
    return np.array([] if x is None else x, kind)


def rankings(rows: pd.DataFrame) -> pd.DataFrame:
    """``resume_text, vacancy_text, representation, ngrams, p, t`` of one CV's rows and its vacancies' with their ``rank``."""
    rows = rows.sort_values(["side", "id", "kind"])
    side, kind, ids = rows["side"].to_numpy(), rows["kind"].to_numpy(), rows["id"].to_numpy()
    out = []
    if (side == "cv").any() and (side == "vacancy").any():
        codes = [np.frombuffer(x.encode("utf-32-le"), "uint32").astype("int64") for x in rows["chars"]]
        hashes = [_array(x, "int64") for x in rows["words"]]
        known = np.unique(np.concatenate(hashes))
        words = [np.searchsorted(known, x) for x in hashes]
        c, w = ({n: _grams(items, n) for n in (1, 2, 3)} for items in (codes, words))
        tfidf = _matrix([_array(x, "int64") for x in rows["terms"]], [_array(x, "float64") for x in rows["w"]])
        e = np.array([_array(x, "float64") for x in rows["e"]])
        vectors = [*(np.hstack([g[n] for n in range(lo, hi + 1)]) for g in (c, w) for lo, hi in RANGES), tfidf, e, np.hstack([c[1], c[2], c[3], w[1], w[2], tfidf, e])]
        for (representation, ngrams), m in zip(REPRESENTATIONS, vectors):
            m = _unit(m)
            for i in np.flatnonzero(side == "cv"):
                gap = np.round(np.abs(m - m[i]).sum(axis=1), 9)
                for v in TYPES:
                    at = np.flatnonzero((side == "vacancy") & (kind == v))
                    place = np.empty(len(at))
                    place[np.lexsort((ids[at], gap[at]))] = np.arange(1, len(at) + 1)
                    out.append((kind[i], v, representation, ngrams, place, rows["rank"].to_numpy()[at].astype(float)))
    return pd.DataFrame(out, columns=["resume_text", "vacancy_text", "representation", "ngrams", "p", "t"])


def grid(cvs: DataFrame, vacancies: DataFrame, truth: DataFrame) -> DataFrame:
    """The rankings above of every CV of ``cv_id, vacancy_id, rank``, from ``cv_id, text`` and ``vacancy_id, text``.

    Of several texts under one id the least counts. A CV's group is its texts and those of its ranked vacancies.
    """
    one = lambda d, key, side: d.where(F.col(key).isNotNull() & F.col("text").isNotNull()).join(truth.select(key).distinct(), key, "left_semi").groupBy(F.lit(side).alias("side"), F.col(key).alias("id")).agg(F.min("text").alias("text"))
    typed = materialize(text_types(one(cvs, "cv_id", "cv").unionByName(one(vacancies, "vacancy_id", "vacancy"))), "types")
    f = materialize(features(typed, typed.count()), "features")
    own = f.where("side = 'cv'").withColumns({"cv_id": F.col("id"), "rank": F.lit(None).cast("int")})
    ranked = f.where("side = 'vacancy'").join(truth.select("cv_id", F.col("vacancy_id").alias("id"), F.col("rank").cast("int").alias("rank")), "id")
    return own.unionByName(ranked).groupBy("cv_id").applyInPandas(rankings, "resume_text string, vacancy_text string, representation string, ngrams string, p array<double>, t array<double>")
