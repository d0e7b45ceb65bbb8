"""The whole run: documents to features, pairs, scores, ranks of every method, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import checks as C
from braidwork.functions import text as T
from braidwork.operators import matching as K
from braidwork.operators import metrics as M
from braidwork.operators import pairs as P
from braidwork.operators import ranking as R
from braidwork.operators import semantic as S
from braidwork.operators import terms as G
from braidwork.session import materialize

METHODS = {"unified": "total_score", "tfidf": "tfidf_score", "semantic": "semantic_score", "bm25": "bm25", "ensemble": "ensemble", "bidirectional": "bidirectional", "competition": "competition"}


@dataclass
class Run:
    resumes: DataFrame
    vacancies: DataFrame
    pairs: DataFrame
    ranks: DataFrame

    def metrics(self, truth: DataFrame) -> DataFrame:
        """``method`` and all metrics against ``cv_id, vacancy_id, rank``."""
        return M.evaluate(M.aligned(self.ranks, truth, ["method", "cv_id"], "vacancy_id", "place", "rank"), ["method"])


def analyse_resumes(docs: DataFrame, english_only: bool = True) -> DataFrame:
    """``cv_id, raw_text`` to cleaned text, skills, experience, grammar score, issue counts and flags."""
    d = docs.where(T.guess_language(F.col("raw_text")) == "en") if english_only else docs
    d = d.withColumn("text", T.clean(F.col("raw_text")))
    return d.select(
        "cv_id", "raw_text", "text", T.tech_skills(F.col("text")).alias("skills"), T.experience(F.col("text")).alias("experience"), C.grammar(F.col("text"))["score"].alias("grammar_score"),
        F.size(C.all_checks(F.col("text"))).alias("error_count"), F.size(T.words(F.col("text"))).alias("word_count"), F.col("raw_text").rlike(C.X.EMAIL).alias("has_email"), F.col("raw_text").rlike(C.X.PHONE).alias("has_phone"),
    )


def analyse_vacancies(raw: DataFrame) -> DataFrame:
    """``vacancy_id, job_title, job_description`` to cleaned text and required years."""
    return raw.select("vacancy_id", "job_title", T.clean(F.col("job_description")).alias("job_description"), T.required_years(F.col("job_description")).alias("required_years"))


def candidate_pairs(resumes: DataFrame, vacancies: DataFrame, per_block: int = 1000) -> DataFrame:
    """Every resume with every vacancy, whether they share a skill or not: the methods other than keywords need none.

    Both sides are cut into blocks of about ``per_block`` ids, and the pairs of two blocks are made by an equi-join on
    the two block numbers, so that no task has more than about ``per_block`` squared pairs. Null ids are in no pair.
    """
    c, v = (d.select(k).where(F.col(k).isNotNull()).distinct() for d, k in ((resumes, "cv_id"), (vacancies, "vacancy_id")))
    n, m = (max(1, -(-d.count() // per_block)) for d in (c, v))
    c = c.withColumn("__c", F.pmod(F.xxhash64("cv_id"), F.lit(n)).cast("int")).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    v = v.withColumn("__v", F.pmod(F.xxhash64("vacancy_id"), F.lit(m)).cast("int")).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return c.join(v, ["__c", "__v"]).select("cv_id", "vacancy_id")


def score(resumes: DataFrame, vacancies: DataFrame, pairs: DataFrame, synonyms: dict[str, str], features: int = 1000) -> DataFrame:
    """The pair table: keyword, TF-IDF, semantic, BM25 and unified scores of the given pairs, written once.

    ``keyword_reverse`` is the keyword score in the ranking of a vacancy's resumes, where years of experience count.
    """
    c = K.cv_features(resumes, synonyms)
    v = K.vacancy_features(vacancies, synonyms)
    alike = K.fuzzy_table(c.select(F.explode("norm").alias("a")), v.select(F.explode("each").alias("b"))).select("a", "b")
    kw = K.keyword_match(pairs, c, v, materialize(alike, "alike"))
    kw = K.both_directions(kw, resumes.select("cv_id", F.col("experience").cast("double").alias("experience")), vacancies.select("vacancy_id", F.col("required_years").alias("required")))
    kw = kw.select("cv_id", "vacancy_id", "keyword_score", F.col("reverse").alias("keyword_reverse"))
    corpus = resumes.select(F.lit("cv").alias("kind"), F.col("cv_id").alias("id"), "text").unionByName(vacancies.select(F.lit("vacancy").alias("kind"), F.col("vacancy_id").alias("id"), F.col("job_description").alias("text")))
    counts = G.term_counts(corpus, ["kind", "id"], G.word_ngrams(F.col("text")))
    w = G.tfidf(counts, ["kind", "id"], corpus.count(), G.vocabulary(counts, features))
    side = lambda kind, key: w.where(F.col("kind") == kind).select(F.col("id").alias(key), "term", "w")
    tf = G.pair_dot(pairs, side("cv", "cv_id"), side("vacancy", "vacancy_id"), "cv_id", "vacancy_id").withColumn("tfidf_score", F.least(F.lit(100.0), 100 * F.col("dot"))).drop("dot")
    ce = resumes.select("cv_id", S.encode(T.prepare(F.col("text"))).alias("a"))
    ve = vacancies.select("vacancy_id", S.encode(T.prepare(F.col("job_description"))).alias("b"))
    sem = pairs.join(ce, "cv_id").join(ve, "vacancy_id").select("cv_id", "vacancy_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * S.dot(F.col("a"), F.col("b")))).alias("semantic_score"))
    bm = S.bm25(pairs, resumes.select("cv_id", G.tokens(F.col("text")).alias("tokens")), vacancies.select("vacancy_id", G.tokens(F.col("job_description")).alias("tokens")))
    d = kw.join(tf, ["cv_id", "vacancy_id"]).join(sem, ["cv_id", "vacancy_id"]).join(bm, ["cv_id", "vacancy_id"])
    d = P.unified(d).withColumnRenamed("unified", "total_score")
    return materialize(R.competition(R.bidirectional(R.ensemble(d))), "pairs")


def rank_all(scored: DataFrame) -> DataFrame:
    """``method, cv_id, vacancy_id, score, place`` of all methods, from one pair table."""
    out = None
    for method, column in METHODS.items():
        d = scored.select("cv_id", "vacancy_id", F.col(column).alias("score"))
        r = R.rank_in_groups(d, "cv_id", "score", ["vacancy_id"] if method == "unified" else [F.desc("vacancy_id")], out="place").select(F.lit(method).alias("method"), "cv_id", "vacancy_id", "score", "place")
        out = r if out is None else out.unionByName(r)
    return out


def run(resumes: DataFrame, vacancies: DataFrame, catalog: DataFrame, pairs: DataFrame | None = None, english_only: bool = True) -> Run:
    """From raw documents to the ranks of all methods; of all pairs, or of ``pairs``, which must be ``cv_id, vacancy_id``.

    To match a set of resumes only, pass ``candidate_pairs`` of them and the vacancies.
    """
    synonyms = K.synonym_map(catalog)
    r, v = materialize(analyse_resumes(resumes, english_only), "resumes"), materialize(analyse_vacancies(vacancies), "vacancies")
    p = materialize(candidate_pairs(r, v) if pairs is None else pairs, "candidates")
    scored = score(r, v, p, synonyms)
    return Run(r, v, scored, rank_all(scored))
