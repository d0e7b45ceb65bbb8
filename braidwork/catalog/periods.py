"""Queries over work periods and other intervals, neighbours in order, and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.catalog.base import CV, Tables, lit, query
from braidwork.catalog.matches import _weights_sql, weights
from braidwork.catalog.ranks import PAIRS, TRUTH, pairs, votes
from braidwork.catalog.texts import _SECTION, _explicit_sql
from braidwork.functions import lexicons as X
from braidwork.functions import text as T
from braidwork.operators import ballots as B
from braidwork.operators import experience as E
from braidwork.operators import grid as N
from braidwork.operators import metrics as M
from braidwork.operators import terms as G

_LISTS = [f"list_transform(list_zip(regexp_extract_all(section, {lit(p)}, {a}), regexp_extract_all(section, {lit(p)}, {b})), lambda z: {{'s': CAST(z[1] AS INTEGER), 'e': coalesce(TRY_CAST(z[2] AS INTEGER), 2026)}})" for p, a, b in X.WORK_PERIODS]
_ROWS = f"(SELECT DISTINCT cv_id, p.s AS s, p.e AS e FROM (SELECT cv_id, unnest(list_concat({', '.join(_LISTS)})) AS p FROM {_SECTION}))"


def _islands_sql(rows: str, tolerance: int = 0) -> str:
    return f"""(SELECT *, sum(fresh) OVER (PARTITION BY cv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN reached IS NULL OR s > reached + {tolerance} THEN 1 ELSE 0 END AS fresh FROM
(SELECT *, max(e) OVER (PARTITION BY cv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {rows})))"""


def _union_sql(rows: str, tolerance: int = 0) -> str:
    return f"(SELECT cv_id, count(*) AS n_islands, CAST(sum(y) AS DOUBLE) AS years FROM (SELECT cv_id, island, max(e) - min(s) AS y FROM {_islands_sql(rows, tolerance)} GROUP BY ALL) GROUP BY cv_id)"


def rows(t: Tables) -> DataFrame:
    sections = t.cv.select("cv_id", T.experience_section(F.col("text")).alias("section"))
    return E.period_rows(sections, "cv_id", T.work_periods(F.col("section")))


@query(f"SELECT * FROM {_union_sql(_ROWS)}")
def q_interval_union(t: Tables) -> DataFrame:
    return E.union_years(rows(t), "cv_id")


@query(f"SELECT * FROM {_union_sql(_ROWS, 1)}")
def q_interval_adjacent(t: Tables) -> DataFrame:
    return E.union_years(rows(t), "cv_id", tolerance=1)


@query(f'SELECT cv_id, s AS "start", e AS "end", reached, CAST(fresh AS INTEGER) AS new, CAST(island AS BIGINT) AS island FROM {_islands_sql(_ROWS)}')
def q_island_flags(t: Tables) -> DataFrame:
    return E.islands(rows(t), "cv_id").select("cv_id", "start", "end", "reached", "new", "island")


@query(f"SELECT c.cv_id, CASE WHEN section = '' THEN {_explicit_sql('text')} ELSE coalesce(u.years, 0.0) END AS years FROM {_SECTION} c LEFT JOIN {_union_sql(_ROWS)} u USING (cv_id)")
def q_total_experience(t: Tables) -> DataFrame:
    """The union of the experience section's periods, folded in one expression without a shuffle."""
    return t.cv.select("cv_id", T.experience(F.col("text")).alias("years"))



_CP = lit(E.CONTEXT_PERIOD)
_CONTEXT = f"""(SELECT DISTINCT cv_id, CAST(regexp_extract(x, {_CP}, 1) AS INTEGER) AS s, coalesce(TRY_CAST(regexp_extract(x, {_CP}, 2) AS INTEGER), 2026) AS e FROM
(SELECT cv_id, x, lower(substr(text, greatest(0, place - 50) + 1, place - greatest(0, place - 50) + length(x) + 50)) AS around FROM
(SELECT cv_id, text, m[i] AS x, length(array_to_string(list_slice(g, 1, i), '')) + length(array_to_string(list_slice(m, 1, i - 1), '')) AS place FROM
(SELECT cv_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT cv_id, text, regexp_extract_all(text, {_CP}) AS m, regexp_split_to_array(text, {_CP}) AS g FROM {CV})))) WHERE NOT contains(around, 'education') AND NOT contains(around, 'university'))"""


@query(f"SELECT * FROM {_union_sql(_CONTEXT)}")
def q_context_periods(t: Tables) -> DataFrame:
    return E.union_years(E.context_periods(t.cv, "cv_id", "text"), "cv_id")


_MENTION = f"""(SELECT cv_id, i, g, CASE WHEN regexp_matches(m, '[0-9]') THEN CAST(regexp_extract(m, '([0-9]{{4}})', 1) AS INTEGER) ELSE 2026 END AS y, regexp_matches(m, '[0-9]') AS closed FROM
(SELECT cv_id, unnest(d) AS m, generate_subscripts(d, 1) AS i, gaps[generate_subscripts(d, 1) + 1] AS g FROM (SELECT cv_id, regexp_extract_all(text, {lit(X.DATE_MENTION)}) AS d, regexp_split_to_array(text, {lit(X.DATE_MENTION)}) AS gaps FROM {CV})))"""


@query(f"""SELECT DISTINCT cv_id, y AS "start", n AS "end" FROM (SELECT *, lead(y) OVER (PARTITION BY cv_id ORDER BY i) AS n FROM {_MENTION}) WHERE closed AND regexp_replace(g, '^\\s+|\\s+$', '', 'g') IN ('-', '–', '—', 'to') AND y < n""")
def q_mention_periods(t: Tables) -> DataFrame:
    return E.mention_periods(t.cv, "cv_id", "text", X.DATE_MENTION)


_MP = f"""(SELECT cv_id, sum(n - y) AS total, count(*) AS n_periods FROM (SELECT DISTINCT cv_id, y, n FROM (SELECT *, lead(y) OVER (PARTITION BY cv_id ORDER BY i) AS n FROM {_MENTION}) WHERE closed AND regexp_replace(g, '^\\s+|\\s+$', '', 'g') IN ('-', '–', '—', 'to') AND y < n) GROUP BY cv_id)"""


@query(f"""SELECT cv_id, CASE WHEN years = 0 AND total IS NOT NULL THEN CAST(total AS DOUBLE) ELSE years END AS years, CASE WHEN years = 0 AND total IS NOT NULL THEN 'ner' ELSE 'regex' END AS method
FROM (SELECT c.cv_id, CASE WHEN section = '' THEN {_explicit_sql('text')} ELSE coalesce(u.years, 0.0) END AS years FROM {_SECTION} c LEFT JOIN {_union_sql(_ROWS)} u USING (cv_id)) LEFT JOIN {_MP} USING (cv_id)""")
def q_experience_choice(t: Tables) -> DataFrame:
    mentioned = E.mention_periods(t.cv, "cv_id", "text", X.DATE_MENTION).groupBy("cv_id").agg(F.collect_set(F.struct("start", "end")).alias("p"))
    d = t.cv.select("cv_id", T.experience(F.col("text")).alias("y")).join(mentioned, "cv_id", "left")
    years, method = E.choose(F.col("y"), F.coalesce("p", F.array().cast("array<struct<start:int,end:int>>")))
    return d.select("cv_id", years.alias("years"), method.alias("method"))


_W = r"([\p{L}\p{N}_+#.-]+)"


@query(f"SELECT cv_id, w[i] AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT cv_id, w, unnest(range(1, len(w))) AS i FROM (SELECT cv_id, regexp_extract_all(lower(text), {lit(_W)}, 1) AS w FROM {CV})) WHERE w[i] = w[i + 1] AND length(w[i]) > 1 GROUP BY ALL")
def q_adjacent(t: Tables) -> DataFrame:
    """Words that follow themselves, by ``lead`` over the document's words."""
    w = t.cv.select("cv_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(_W), F.lit(1))).alias("i", "word"))
    d = w.withColumn("next", F.lead("word").over(Window.partitionBy("cv_id").orderBy("i")))
    return d.where((F.col("word") == F.col("next")) & (F.length("word") > 1)).groupBy("cv_id", "word").agg(F.count("*").alias("n"))


@query(f"SELECT kind, id, string_agg(term, '|' ORDER BY place) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY round(w, 9) DESC, term) AS place FROM {_weights_sql(True)}) WHERE place <= 20 GROUP BY kind, id")
def q_keyphrases(t: Tables) -> DataFrame:
    """The 20 phrases of one or two words with the highest TF-IDF weight."""
    w = weights(t).withColumn("key", F.concat_ws(":", "kind", "id"))
    top = G.top_terms(w, "key", 20).groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("p"))
    return top.select("kind", "id", F.array_join(F.transform("p", lambda x: x["term"]), "|").alias("phrases"))


@query("SELECT DISTINCT result_id, list_slice(matched_skills, 1, 20) AS matched, list_slice(missing_skills, 1, 20) AS missing FROM match_results WHERE matched_skills IS NOT NULL AND missing_skills IS NOT NULL".replace("list_slice(matched_skills, 1, 20) AS matched, list_slice(missing_skills, 1, 20) AS missing", "len(list_slice(matched_skills, 1, 20)) AS n_matched, len(list_slice(missing_skills, 1, 20)) AS n_missing"))
def q_top_slices(t: Tables) -> DataFrame:
    m = t.match_results.where("matched_skills IS NOT NULL AND missing_skills IS NOT NULL")
    return m.select("result_id", F.size(F.slice("matched_skills", 1, 20)).cast("bigint").alias("n_matched"), F.size(F.slice("missing_skills", 1, 20)).cast("bigint").alias("n_missing")).distinct()


@query("SELECT DISTINCT result_id, len(list_distinct(matched_skills)) AS n_distinct FROM match_results WHERE matched_skills IS NOT NULL AND len(list_filter(matched_skills, lambda s: s IS NULL)) = 0")
def q_distinct(t: Tables) -> DataFrame:
    m = t.match_results.where(F.col("matched_skills").isNotNull() & ~F.exists("matched_skills", lambda s: s.isNull()))
    return m.select("result_id", F.size(F.array_distinct("matched_skills")).cast("bigint").alias("n_distinct")).distinct()


@query(f"SELECT cv_id, vacancy_id, total_score FROM {PAIRS}")
def q_json_roundtrip(t: Tables) -> DataFrame:
    """Each row to JSON text and back by an explicit schema."""
    j = pairs(t).select(F.to_json(F.struct("cv_id", "vacancy_id", "total_score")).alias("j"))
    return j.select(F.from_json("j", "cv_id bigint, vacancy_id bigint, total_score double").alias("r")).select("r.*")


@query()
def q_vm_grid(t: Tables) -> DataFrame:
    """Mean alpha and Spearman correlation with the consensus of ranking by L1 distance: four text types on either side,
    nine representations, 144 configurations.

    Candidates are the vacancies of the ballots. The three representations without an n-gram range are not repeated
    for each range: the other 96 of the 240 configurations would give the same.
    """
    lists = N.grid(t.cv, t.vac.select("vacancy_id", F.col("job_description").alias("text")), B.consensus(votes(t)))
    m = lists.select("resume_text", "vacancy_text", "representation", "ngrams", M.alpha(F.col("p"), F.col("t")).alias("alpha"), M.spearman(F.col("p"), F.col("t")).alias("rho"))
    return m.groupBy("resume_text", "vacancy_text", "representation", "ngrams").agg(F.round(F.avg("alpha"), 4).alias("alpha"), F.round(F.avg("rho"), 4).alias("rho"), F.count("*").alias("n"))


@query(f"SELECT cv_id, coalesce(list_ranks, '1,2,3,4,5') AS ranks FROM (SELECT DISTINCT cv_id FROM cv_data) LEFT JOIN (SELECT cv_id, string_agg(rank, ',' ORDER BY vacancy_id) AS list_ranks FROM {TRUTH} GROUP BY cv_id) USING (cv_id)")
def q_ground_truth(t: Tables) -> DataFrame:
    """Every CV's consensus list in order of vacancy, with 1 to 5 as the default."""
    truth = B.consensus(votes(t)).groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct("vacancy_id", "rank"))).alias("r"))
    ranks = F.array_join(F.transform("r", lambda x: x["rank"].cast("string")), ",")
    return t.cv_data.select("cv_id").distinct().join(truth, "cv_id", "left").select("cv_id", F.coalesce(ranks, F.lit("1,2,3,4,5")).alias("ranks"))
