"""Matching of skill lists: normalisation, four kinds of match, weights, bonus, penalty and the keyword score."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import lexicons as X
from braidwork.functions import text as T


def normalize(skills: Column) -> Column:
    """Lower-cased, stripped skills without stop words (kept if all are), distinct, without empty ones; null is empty."""

    def one(s: Column) -> Column:
        low = F.trim(F.lower(s))
        kept = F.array_join(F.filter(T.words(low), lambda w: ~w.isin(*X.STOP_WORDS)), " ")
        return F.when(kept == "", low).otherwise(kept)

    known = F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: s.isNotNull())
    return F.array_distinct(F.filter(F.transform(known, one), lambda s: s != ""))


def reference_names(catalog: DataFrame, most: int = 200_000) -> list[tuple[str, str]]:
    """``(name, canonical name)`` in the order of ``catalog_id`` of ``catalog_id, canonical, other_names``, lower-cased
    names; more than ``most`` entries are an error, since the list goes to every task."""
    rows = catalog.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    return [(n.lower(), r["canonical"]) for r in sorted(rows, key=lambda r: (r["catalog_id"], r["canonical"])) for n in (r["canonical"], *(r["other_names"] or ())) if n]


def first_named(text: Column, names: list[tuple[str, str]]) -> Column:
    """The canonical name of the first list entry, one of whose names occurs in the text, else null.

    All names are searched for at once, by one automaton per task: the work follows the text, not the list.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, (name, _) in enumerate(names):
            if not automaton.exists(name):
                automaton.add_word(name, place)
        if names:
            automaton.make_automaton()
        for texts in batches:
            places = [min((p for _, p in automaton.iter(t.lower())), default=None) if t and names else None for t in texts]
            yield pd.Series([None if p is None else names[p][1] for p in places], dtype="object")

    return run(text)


def synonym_map(catalog: DataFrame, most: int = 10_000) -> dict[str, str]:
    """Name -> canonical name, lower-cased, from a reference list of at most ``most`` entries; the lowest id wins."""
    rows = catalog.where("entry_kind = 'skill'").orderBy("catalog_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    out: dict[str, str] = {}
    for r in rows:
        for n in (r["canonical"], *(r["other_names"] or ())):
            out.setdefault(n.lower(), r["canonical"].lower())
    return out


def canonical(skills: Column, synonyms: dict[str, str]) -> Column:
    """Each skill's canonical name, or the skill itself, distinct. The map is searched from its front: keep it short."""
    if not synonyms:
        return F.array_distinct(skills)
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.array_distinct(F.transform(skills, lambda s: F.coalesce(F.try_element_at(m, s), s)))


def cv_features(cvs: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """``cv_id, raw, norm, canon`` of ``cv_id, skills``; ``raw`` are the words of each skill as it stands."""
    raw = F.transform(F.filter(F.coalesce("skills", F.array().cast("array<string>")), lambda s: s.isNotNull()), F.lower)
    return cvs.select("cv_id", F.transform(raw, lambda s: F.split(s, r"\s+")).alias("raw"), normalize(F.col("skills")).alias("norm")).withColumn("canon", canonical(F.col("norm"), synonyms))


def named_after(text: Column, marker: str, skill: Column) -> Column:
    """Whether a line of the lower-cased text names the skill after the marker."""
    n = len(marker)
    return F.exists(F.split(text, "\n"), lambda l: l.contains(marker) & l.substr(F.instr(l, marker) + n, F.length(l)).contains(skill))


def weight(text: Column, skill: Column) -> Column:
    """A skill's weight in the lower-cased vacancy text, 0.5 to 2: how often, how early, after which markers."""
    count = (F.length(text) - F.length(F.replace(text, skill, F.lit("")))) / F.length(skill)
    w = 1.0 + F.least(count * 0.1, F.lit(0.3)) + F.when(F.substring(text, 1, 500).contains(skill), 0.2).otherwise(0.0)
    for marker, bonus in X.IMPORTANCE:
        w = w + F.when(named_after(text, marker, skill), bonus).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(2.0), w)), 2)


def vacancy_features(vacancies: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """``vacancy_id, low, terms, canon, weights, must, critical`` of ``vacancy_id, job_description``, computed once a vacancy.

    ``terms`` are the technical terms of the text and then its soft skills, not distinct; ``weights`` maps each to its
    weight; ``critical`` are those named after a critical marker.
    """
    v = vacancies.select("vacancy_id", F.lower("job_description").alias("low"))
    v = v.withColumn("skills", normalize(T.tech_skills(F.col("low")))).withColumn("soft", T.contained(F.col("low"), X.SOFT_SKILLS))
    v = v.withColumn("terms", F.concat("skills", "soft")).withColumn("each", F.array_distinct("terms"))
    low = F.col("low")
    critical = F.filter("each", lambda s: named_after(low, X.CRITICAL[0], s) | named_after(low, X.CRITICAL[1], s) | named_after(low, X.CRITICAL[2], s))
    return v.select(
        "vacancy_id", "low", "skills", "terms", "each", canonical(F.col("each"), synonyms).alias("vcanon"), F.transform("each", lambda s: weight(low, s)).alias("w"),
        F.regexp_extract("low", X.MUST_SECTION, 1).alias("must"), critical.alias("critical"), phrases(F.col("each")).alias("phrases"),
    ).withColumn("weights", F.map_from_arrays("each", "w"))


def fuzzy_table(left: DataFrame, right: DataFrame, threshold: float = 0.85, band: int = 5) -> DataFrame:
    """``a, b`` of all distinct terms of two columns ``a`` and ``b`` whose sequence ratio exceeds ``threshold``.

    Only terms whose lengths differ by ``band`` or less can match; they meet by length, the shorter list spread
    over the band, and each pair is compared once, in Arrow batches.
    """
    a = left.distinct().withColumn("n", F.length("a")).withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - band), F.col("n") + band)))
    pairs = a.join(right.distinct().withColumn("k", F.length("b")), "k").select("a", "b")

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") > threshold)


def phrases(terms: Column) -> Column:
    """``array<struct<term,words>>`` of the terms of two or more different words."""
    return F.filter(F.transform(terms, lambda v: F.struct(v.alias("term"), F.array_distinct(F.split(v, r"\s+")).alias("words"))), lambda x: F.size(x["words"]) > 1)


def partial_matches(own_phrases: Column, raw: Column) -> Column:
    """Phrases of which a resume skill has at least half of the words."""
    hits = F.filter(own_phrases, lambda v: F.exists(raw, lambda r: 2 * F.size(F.array_intersect(v["words"], r)) >= F.size(v["words"])))
    return F.transform(hits, lambda v: v["term"])


def keyword_match(pairs: DataFrame, cvs: DataFrame, vacancies: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """``cv_id, vacancy_id`` with exact, synonym, fuzzy and partial matches, what is missing, and the keyword score.

    ``cvs`` and ``vacancies`` are the features above, so that a pair costs no regular expression. The score is the
    matched share of the weights (a canonical name that the vacancy does not weigh counts 0.9), plus 2 for each match
    in the must-have section (15 at most), less 10 for each critical and 3 for each other missing skill (40 at most),
    within 0..100, to one digit; 15 more for remote work. A vacancy without skills scores 0.
    """
    none = F.array().cast("array<string>")
    if fuzzy is not None:
        reach = cvs.select("cv_id", F.explode("norm").alias("a")).join(fuzzy, "a").groupBy("cv_id").agg(F.collect_set("b").alias("reach"))
        cvs = cvs.join(reach, "cv_id", "left")
    else:
        cvs = cvs.withColumn("reach", none)
    d = pairs.join(cvs, "cv_id").join(vacancies, "vacancy_id")
    d = d.withColumn("exact", F.array_intersect("each", "norm")).withColumn("synonym", F.array_intersect("vcanon", "canon"))
    d = d.withColumn("fuzzy", F.array_intersect("each", F.coalesce("reach", none))).withColumn("partial", partial_matches(F.col("phrases"), F.col("raw")))
    d = d.withColumn("matched", F.array_distinct(F.concat("exact", "synonym", "fuzzy", "partial"))).withColumn("missing", F.array_except("each", "matched"))
    got = F.aggregate("matched", F.lit(0.0), lambda s, m: s + F.coalesce(F.try_element_at("weights", m), F.lit(0.9)))
    whole = F.aggregate("terms", F.lit(0.0), lambda s, m: s + F.coalesce(F.try_element_at("weights", m), F.lit(1.0)))
    d = d.withColumn("share", F.coalesce(F.try_divide(got, whole) * 100, F.lit(0.0)))
    d = d.withColumn("bonus", F.least(F.lit(15), F.size(F.filter("matched", lambda m: F.col("must").contains(m))) * 2))
    d = d.withColumn("penalty", F.least(F.lit(40), 3 * F.size("missing") + 7 * F.size(F.array_intersect("missing", "critical"))))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("share") + F.col("bonus")) - F.col("penalty"))
    # to six digits first: the order of a sum must not decide a tie of the rounding
    base = F.floor(F.floor(raw * 1e6 + 0.5) / 1e6 * 10 + 0.5) / 10
    remote = F.col("low").contains("remote") | F.col("low").contains("work from home")
    score = F.when(F.size("skills") == 0, 0.0).otherwise(F.when(remote, F.least(F.lit(100.0), base + 15)).otherwise(base))
    return d.select("cv_id", "vacancy_id", "exact", "synonym", "fuzzy", "partial", "matched", "missing", "weights", "share", "bonus", "penalty", score.alias("keyword_score"))


def with_experience(score: Column, experience: Column, required: Column) -> Column:
    """The keyword score with the experience rule: 5 less beyond twice the required years, 5 more from them on."""
    adjusted = F.when(experience > 2 * required, score - 5).when(experience >= required, score + 5).otherwise(score)
    return F.when(experience.isNull() | required.isNull(), score).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), adjusted)))


def both_directions(matches: DataFrame, experience: DataFrame, required: DataFrame) -> DataFrame:
    """Adds ``forward`` and ``reverse`` keyword scores: the experience rule acts on a vacancy's ranking of resumes only.

    ``experience``: ``cv_id, experience``; ``required``: ``vacancy_id, required``; ids without one are left unchanged.
    """
    d = matches.join(experience, "cv_id", "left").join(required, "vacancy_id", "left")
    return d.withColumn("forward", F.col("keyword_score")).withColumn("reverse", with_experience(F.col("keyword_score"), F.col("experience"), F.col("required"))).drop("experience", "required")


def explanation(matches: DataFrame) -> DataFrame:
    """``cv_id, vacancy_id, explanation``: a band, up to 5 exact, 3 synonym and 3 fuzzy matches, up to 8 missing skills,
    those of weight above 1.2 flagged."""
    s = F.col("keyword_score")
    band = F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "medium").otherwise("weak")

    def some(name: str, n: int) -> Column:
        return F.concat(F.lit(f"{name}: "), F.array_join(F.slice(F.array_sort(name), 1, n), ", "))

    missing = F.transform(F.slice(F.array_sort("missing"), 1, 8), lambda m: F.when(F.coalesce(F.try_element_at("weights", m), F.lit(1.0)) > 1.2, F.concat(m, F.lit("!"))).otherwise(m))
    text = F.concat_ws("\n", F.concat(s.cast("string"), F.lit(" "), band), some("exact", 5), some("synonym", 3), some("fuzzy", 3), F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return matches.select("cv_id", "vacancy_id", text.alias("explanation"))
