"""Queries over scored pairs and rankings: ranks, ensembles, consensus, metrics, tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.catalog.base import Tables, query, rnd, rnd_sql
from braidwork.operators import ballots as B
from braidwork.operators import metrics as M
from braidwork.operators import pairs as P
from braidwork.operators import ranking as R

_OK = " AND ".join(f"{s} IS NOT NULL AND NOT isnan({s}) AND {s} BETWEEN 0 AND 100" for s in P.SCORES)
PAIRS = f"""(SELECT cv_id, vacancy_id, keyword_score, tfidf_score, semantic_score, total_score FROM (SELECT DISTINCT cv_id, vacancy_id, keyword_score, tfidf_score, semantic_score, total_score, scored_at, result_id FROM match_results)
WHERE cv_id IS NOT NULL AND vacancy_id IS NOT NULL AND {_OK} QUALIFY row_number() OVER (PARTITION BY cv_id, vacancy_id ORDER BY scored_at DESC NULLS LAST, result_id DESC) = 1)"""
VOTES = """(WITH r AS (SELECT DISTINCT ballot_id, annotator, cv_id, vacancy_id, rank_no, annotated_at FROM annotations WHERE ballot_id IS NOT NULL AND annotator IS NOT NULL AND cv_id IS NOT NULL),
b AS (SELECT cv_id, annotator, ballot_id, max(annotated_at) AS given FROM r GROUP BY ALL
 HAVING count(*) = 5 AND count(vacancy_id) = 5 AND count(DISTINCT vacancy_id) = 5 AND count(DISTINCT rank_no) = 5 AND min(rank_no) = 1 AND max(rank_no) = 5),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cv_id, annotator ORDER BY given DESC NULLS LAST, ballot_id DESC) = 1)
SELECT r.cv_id, r.annotator, r.vacancy_id, r.rank_no FROM r JOIN n USING (cv_id, annotator, ballot_id))"""
TRUTH = f"""(SELECT cv_id, vacancy_id, mean_rank, row_number() OVER (PARTITION BY cv_id ORDER BY mean_rank, vacancy_id DESC) AS rank FROM
(SELECT cv_id, vacancy_id, avg(rank_no) AS mean_rank FROM {VOTES} WHERE cv_id IN (SELECT cv_id FROM {VOTES} GROUP BY 1 HAVING count(DISTINCT annotator) >= 2) GROUP BY ALL))"""
#: Each counting ballot beside the consensus.
BOTH = f"(SELECT v.annotator, v.cv_id, v.vacancy_id, v.rank_no AS p, c.rank AS t FROM {VOTES} v JOIN {TRUTH} c USING (cv_id, vacancy_id))"


def pairs(t: Tables) -> DataFrame:
    return P.latest_pairs(t.match_results)


def votes(t: Tables) -> DataFrame:
    return B.counting_ballots(t.annotations)


def lists(t: Tables) -> DataFrame:
    """``annotator, cv_id, p, t``: each counting ballot beside the consensus."""
    v = votes(t)
    return M.aligned(v, B.consensus(v), ["annotator", "cv_id"], "vacancy_id", "rank_no", "rank")


@query(f"SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY total_score DESC, vacancy_id) AS INTEGER) AS rank FROM {PAIRS}")
def q_rank_unified(t: Tables) -> DataFrame:
    return R.rank_in_groups(pairs(t), "cv_id", "total_score", ["vacancy_id"]).select("cv_id", "vacancy_id", "rank")


@query(f"SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY vacancy_id ORDER BY total_score DESC, cv_id) AS INTEGER) AS rank FROM {PAIRS}")
def q_rank_rev(t: Tables) -> DataFrame:
    return R.rank_in_groups(pairs(t), "vacancy_id", "total_score", ["cv_id"]).select("cv_id", "vacancy_id", "rank")


@query(f"SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY 100 - tfidf_score, vacancy_id) AS INTEGER) AS rank FROM {PAIRS}")
def q_rank_dist(t: Tables) -> DataFrame:
    d = pairs(t).withColumn("distance", 100 - F.col("tfidf_score"))
    return R.rank_in_groups(d, "cv_id", "distance", ["vacancy_id"], descending=False).select("cv_id", "vacancy_id", "rank")


@query(f"SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY semantic_score DESC, vacancy_id DESC) AS INTEGER) AS rank FROM {PAIRS}")
def q_rank_desc_ties(t: Tables) -> DataFrame:
    return R.rank_in_groups(pairs(t), "cv_id", "semantic_score", [F.desc("vacancy_id")]).select("cv_id", "vacancy_id", "rank")


@query(f"SELECT cv_id, vacancy_id, {rnd_sql("0.60 * keyword_score + 0.25 * tfidf_score + 0.15 * semantic_score", 1)} AS unified FROM {PAIRS}")
def q_unified(t: Tables) -> DataFrame:
    return P.unified(pairs(t)).select("cv_id", "vacancy_id", "unified")


_MM = f"(SELECT *, CASE WHEN max(tfidf_score) OVER w > min(tfidf_score) OVER w THEN (tfidf_score - min(tfidf_score) OVER w) / (max(tfidf_score) OVER w - min(tfidf_score) OVER w) ELSE 0.5 END AS vm FROM {PAIRS} WINDOW w AS (PARTITION BY cv_id))"
_ENS = f"(SELECT *, 100 * (0.5 * total_score / 100 + 0.3 * vm + 0.2 * semantic_score / 100) AS ensemble FROM {_MM})"
_POS = f"(SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY total_score DESC, cv_id) AS position FROM {_ENS})"
_BI = f"(SELECT *, 100 / position AS backward, 0.6 * ensemble + (1 - 0.6) * (100 / position) AS bidirectional FROM {_POS})"
_COMP = f"""(SELECT *, bidirectional * CASE WHEN bidirectional > avg(total_score) OVER w + 1.5 * stddev_pop(total_score) OVER w THEN 0.85 ELSE 1.0 END
 * CASE WHEN position <= floor(0.2 * count(*) OVER w) THEN 1.1 ELSE 1.0 END AS competition FROM {_BI} WINDOW w AS (PARTITION BY vacancy_id))"""


@query(f"SELECT cv_id, vacancy_id, round(vm, 6) AS scaled FROM {_MM}")
def q_minmax(t: Tables) -> DataFrame:
    return R.minmax(pairs(t), "cv_id", "tfidf_score", "scaled").select("cv_id", "vacancy_id", F.round("scaled", 6).alias("scaled"))


@query(f"SELECT cv_id, vacancy_id, {rnd_sql("ensemble", 4)} AS ensemble FROM {_ENS}")
def q_ensemble(t: Tables) -> DataFrame:
    return R.ensemble(pairs(t)).select("cv_id", "vacancy_id", rnd(F.col("ensemble"), 4).alias("ensemble"))


@query(f"SELECT cv_id, vacancy_id, CAST(position AS INTEGER) AS position, round(backward, 6) AS backward FROM {_BI}")
def q_backward(t: Tables) -> DataFrame:
    return R.bidirectional(R.ensemble(pairs(t))).select("cv_id", "vacancy_id", "position", F.round("backward", 6).alias("backward"))


@query(f"SELECT cv_id, vacancy_id, {rnd_sql("bidirectional", 4)} AS bidirectional FROM {_BI}")
def q_bidirectional(t: Tables) -> DataFrame:
    return R.bidirectional(R.ensemble(pairs(t))).select("cv_id", "vacancy_id", rnd(F.col("bidirectional"), 4).alias("bidirectional"))


@query(f"SELECT cv_id, vacancy_id, {rnd_sql("competition", 4)} AS competition FROM {_COMP}")
def q_competition(t: Tables) -> DataFrame:
    return R.competition(R.bidirectional(R.ensemble(pairs(t)))).select("cv_id", "vacancy_id", rnd(F.col("competition"), 4).alias("competition"))


@query(f"SELECT cv_id, vacancy_id FROM (SELECT cv_id, vacancy_id, row_number() OVER (PARTITION BY vacancy_id ORDER BY total_score DESC, cv_id) AS p, count(*) OVER (PARTITION BY vacancy_id) AS n FROM {PAIRS}) WHERE p <= floor(0.2 * n)")
def q_top20pct(t: Tables) -> DataFrame:
    d = R.with_stats(R.rank_in_groups(pairs(t), "vacancy_id", "total_score", ["cv_id"]), "vacancy_id", F.count("*").alias("n"))
    return d.where(F.col("rank") <= F.floor(0.2 * F.col("n"))).select("cv_id", "vacancy_id")


@query(f"SELECT cv_id, round(avg(total_score), 10) AS mean_score, count(*) AS n FROM {PAIRS} GROUP BY cv_id")
def q_mean_score(t: Tables) -> DataFrame:
    return pairs(t).groupBy("cv_id").agg(F.round(F.avg("total_score"), 10).alias("mean_score"), F.count("*").alias("n"))


@query(f"SELECT annotator, cv_id, vacancy_id, round(avg(rank_no) OVER (PARTITION BY annotator, cv_id ORDER BY vacancy_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM {VOTES}")
def q_running_mean(t: Tables) -> DataFrame:
    w = Window.partitionBy("annotator", "cv_id").orderBy("vacancy_id").rowsBetween(Window.unboundedPreceding, 0)
    return votes(t).select("annotator", "cv_id", "vacancy_id", F.round(F.avg("rank_no").over(w), 6).alias("running_mean"))


@query(f"SELECT cv_id, vacancy_id, CAST(rank AS INTEGER) AS rank FROM {TRUTH}")
def q_consensus(t: Tables) -> DataFrame:
    return B.consensus(votes(t)).select("cv_id", "vacancy_id", "rank")


@query("SELECT DISTINCT cv_id, vacancy_ids IS NOT NULL AND coalesce(list_sort(average_ranks) = [1, 2, 3, 4, 5], false) AS valid FROM rank_averages")
def q_valid_perm(t: Tables) -> DataFrame:
    return t.rank_averages.select("cv_id", (F.col("vacancy_ids").isNotNull() & B.valid_lists("average_ranks")).alias("valid")).distinct()


_WIDE = ", ".join(f"coalesce(max(CASE WHEN i = {i} THEN rank_no END), 0) AS rank_{i}" for i in range(1, 6))


@query(f"SELECT annotator, cv_id, {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY annotator, cv_id ORDER BY vacancy_id) AS i FROM {VOTES}) GROUP BY annotator, cv_id")
def q_rank_pivot(t: Tables) -> DataFrame:
    """Rank lists in wide form: column i holds the rank of the ballot's i-th vacancy."""
    w = Window.partitionBy("annotator", "cv_id").orderBy("vacancy_id")
    wide = votes(t).withColumn("i", F.row_number().over(w)).groupBy("annotator", "cv_id").pivot("i", [1, 2, 3, 4, 5]).agg(F.first("rank_no"))
    return wide.select("annotator", "cv_id", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"rank_{i}") for i in range(1, 6)])


@query(f"SELECT annotator, cv_id, vacancy_id, p AS predicted, CAST(t AS INTEGER) AS truth FROM {BOTH}")
def q_gt_join(t: Tables) -> DataFrame:
    v = votes(t)
    return v.join(B.consensus(v), ["cv_id", "vacancy_id"]).select("annotator", "cv_id", "vacancy_id", F.col("rank_no").alias("predicted"), F.col("rank").alias("truth"))


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT cv_id FROM match_results WHERE cv_id IN (SELECT cv_id FROM {TRUTH}))")
def q_semi(t: Tables) -> DataFrame:
    truth = B.consensus(votes(t)).select("cv_id").distinct()
    return t.match_results.select("cv_id").distinct().join(truth, "cv_id", "left_semi").agg(F.count("*").alias("n"))


@query(f"SELECT a.annotator, a.cv_id, a.vacancy_id AS first, b.vacancy_id AS second, (a.p < b.p) = (a.t < b.t) AS concordant FROM {BOTH} a JOIN {BOTH} b ON a.annotator = b.annotator AND a.cv_id = b.cv_id AND a.vacancy_id < b.vacancy_id")
def q_self_pairs(t: Tables) -> DataFrame:
    v = votes(t)
    both = v.join(B.consensus(v), ["cv_id", "vacancy_id"]).select("annotator", "cv_id", "vacancy_id", "rank_no", "rank")
    a, b = both.alias("a"), both.alias("b")
    on = (F.col("a.annotator") == F.col("b.annotator")) & (F.col("a.cv_id") == F.col("b.cv_id")) & (F.col("a.vacancy_id") < F.col("b.vacancy_id"))
    return a.join(b, on).select("a.annotator", "a.cv_id", F.col("a.vacancy_id").alias("first"), F.col("b.vacancy_id").alias("second"), ((F.col("a.rank_no") < F.col("b.rank_no")) == (F.col("a.rank") < F.col("b.rank"))).alias("concordant"))


def _per_list(expression: str) -> str:
    return f"SELECT annotator, cv_id, {expression} FROM {BOTH} GROUP BY annotator, cv_id"


_ALPHA = "1 - avg((p - t) * (p - t)) / (2 * (var_pop(p) + var_pop(t)))"
_KAPPA = "1 - avg((p - t) * (p - t)) / (var_pop(p) + var_pop(t) + pow(avg(p) - avg(t), 2))"
_NDCG = "sum((pow(2, 6 - t) - 1) / log2(p + 1)) / sum((pow(2, 6 - t) - 1) / log2(t + 1))"


@query(_per_list(f"round({_ALPHA}, 4) AS alpha"))
def q_alpha(t: Tables) -> DataFrame:
    return lists(t).select("annotator", "cv_id", F.round(M.alpha(F.col("p"), F.col("t")), 4).alias("alpha"))


_RHO = "corr(p, t)"
_TT = f"(abs({_RHO}) * sqrt(3.0 / greatest(1e-12, 1 - {_RHO} * {_RHO})) / sqrt(3.0))"


@query(f"SELECT annotator, cv_id, round(rho, 4) AS rho, round(greatest(0.0, 1 - (2 / pi()) * (tt / (1 + tt * tt) + atan(tt))), 3) AS p_value FROM ({_per_list(f'{_RHO} AS rho, {_TT} AS tt')})")
def q_spearman(t: Tables) -> DataFrame:
    rho = M.spearman(F.col("p"), F.col("t"))
    return lists(t).select("annotator", "cv_id", rho.alias("r")).select("annotator", "cv_id", F.round("r", 4).alias("rho"), F.round(M.spearman_p(F.col("r")), 3).alias("p_value"))


@query(_per_list(f"round({_KAPPA}, 4) AS quadratic, round(1 - avg(abs(p - t)) / 1.6, 4) AS linear, round(1 - avg(CASE WHEN p <> t THEN 1.0 ELSE 0.0 END) / 0.8, 4) AS unweighted"))
def q_kappa(t: Tables) -> DataFrame:
    p, q = F.col("p"), F.col("t")
    return lists(t).select("annotator", "cv_id", F.round(M.kappa(p, q), 4).alias("quadratic"), F.round(M.kappa(p, q, "linear"), 4).alias("linear"), F.round(M.kappa(p, q, None), 4).alias("unweighted"))


@query(f"SELECT annotator, avg(CASE WHEN a1 = 5 THEN 1.0 ELSE 0.0 END) AS accuracy_1, avg(CASE WHEN a3 = 5 THEN 1.0 ELSE 0.0 END) AS accuracy_3 FROM ({_per_list('count(*) FILTER ((p <= 1) = (t <= 1)) AS a1, count(*) FILTER ((p <= 3) = (t <= 3)) AS a3')}) GROUP BY annotator")
def q_acc_at_k(t: Tables) -> DataFrame:
    p, q = F.col("p"), F.col("t")
    return lists(t).groupBy("annotator").agg(F.avg(M.top_k_equal(p, q, 1).cast("double")).alias("accuracy_1"), F.avg(M.top_k_equal(p, q, 3).cast("double")).alias("accuracy_3"))


@query(_per_list(f"round({_NDCG}, 4) AS ndcg"))
def q_ndcg(t: Tables) -> DataFrame:
    return lists(t).select("annotator", "cv_id", F.round(M.ndcg(F.col("p"), F.col("t")), 4).alias("ndcg"))


@query(f"SELECT annotator, round(avg(rr), 6) AS mrr FROM ({_per_list('max(CASE WHEN t = 1 THEN 1.0 / p ELSE 0.0 END) AS rr')}) GROUP BY annotator")
def q_mrr(t: Tables) -> DataFrame:
    return lists(t).groupBy("annotator").agg(F.round(F.avg(M.reciprocal_rank(F.col("p"), F.col("t"))), 6).alias("mrr"))


_PW = f"(SELECT a.annotator, a.cv_id, avg(CASE WHEN (a.p < b.p) = (a.t < b.t) THEN 1.0 ELSE 0.0 END) AS pw FROM {BOTH} a JOIN {BOTH} b ON a.annotator = b.annotator AND a.cv_id = b.cv_id AND a.vacancy_id < b.vacancy_id GROUP BY ALL)"


@query(f"SELECT annotator, cv_id, round(pw, 4) AS pairwise FROM {_PW}")
def q_pairwise(t: Tables) -> DataFrame:
    return lists(t).select("annotator", "cv_id", F.round(M.pairwise(F.col("p"), F.col("t")), 4).alias("pairwise"))


_EVAL = f"""(SELECT annotator, avg(alpha) AS alpha, avg(rho) AS rho, avg(kappa) AS kappa, avg(a1) AS accuracy_1, avg(a3) AS accuracy_3, avg(ndcg) AS ndcg_5, avg(rr) AS mrr, avg(pw) AS pairwise, count(*) AS n
FROM ({_per_list(f"{_ALPHA} AS alpha, {_RHO} AS rho, {_KAPPA} AS kappa, CASE WHEN count(*) FILTER ((p <= 1) = (t <= 1)) = 5 THEN 1.0 ELSE 0.0 END AS a1, CASE WHEN count(*) FILTER ((p <= 3) = (t <= 3)) = 5 THEN 1.0 ELSE 0.0 END AS a3, {_NDCG} AS ndcg, max(CASE WHEN t = 1 THEN 1.0 / p ELSE 0.0 END) AS rr")}) JOIN {_PW} USING (annotator, cv_id) GROUP BY annotator)"""
_MEANS = ("alpha", "rho", "kappa", "accuracy_1", "accuracy_3", "ndcg_5", "mrr", "pairwise")


@query("SELECT annotator, " + ", ".join(f"round({m}, 4) AS {m}" for m in _MEANS) + f", n FROM {_EVAL}")
def q_evaluate(t: Tables) -> DataFrame:
    return M.evaluate(lists(t), ["annotator"]).select("annotator", *[F.round(m, 4).alias(m) for m in _MEANS], "n")


@query(f"SELECT annotator, round(alpha, 4) AS alpha, CAST(row_number() OVER (ORDER BY round(alpha, 9) DESC, annotator) AS INTEGER) AS place FROM {_EVAL}")
def q_compare(t: Tables) -> DataFrame:
    """Methods by alpha, best first; annotators stand for methods, so the table is as small as their number."""
    e = M.evaluate(lists(t), ["annotator"]).select("annotator", "alpha")
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("alpha", 9)), "annotator"))).select("annotator", F.round("alpha", 4).alias("alpha"), "place")


@query(f"SELECT annotator, alpha, n FROM (SELECT annotator, round(alpha, 4) AS alpha, n FROM {_EVAL}) ORDER BY alpha DESC, annotator LIMIT 10")
def q_metric_sort(t: Tables) -> DataFrame:
    """The ten best methods: a top-k report."""
    return M.evaluate(lists(t), ["annotator"]).select("annotator", F.round("alpha", 4).alias("alpha"), "n").orderBy(F.desc("alpha"), "annotator").limit(10)


def _index_alpha_sql(key: str) -> str:
    """Mean alpha of an annotator's lists by ``key``, on the values' indexes among the distinct values of a list."""
    return f"""(SELECT annotator, avg(alpha) AS alpha FROM (SELECT annotator, {key}, CASE WHEN var_pop(i) = 0 THEN 1.0 ELSE 1 - sum(CASE WHEN side = 1 THEN gap END) / count(*) FILTER (side = 1) / (4 * var_pop(i)) END AS alpha
FROM (SELECT *, i - lead(i) OVER (PARTITION BY annotator, cv_id, vacancy_id ORDER BY side) AS d, pow(i - lead(i) OVER (PARTITION BY annotator, cv_id, vacancy_id ORDER BY side), 2) AS gap FROM
(SELECT annotator, cv_id, vacancy_id, side, dense_rank() OVER (PARTITION BY annotator, {key} ORDER BY v) AS i FROM (SELECT annotator, cv_id, vacancy_id, 1 AS side, p AS v FROM {BOTH} UNION ALL SELECT annotator, cv_id, vacancy_id, 2, t FROM {BOTH}))) GROUP BY annotator, {key}) GROUP BY annotator)"""


@query(f"SELECT annotator, round(c.alpha, 4) AS cv_alpha, round(v.alpha, 4) AS vacancy_alpha, round((c.alpha + v.alpha) / 2, 4) AS combined_alpha FROM {_index_alpha_sql('cv_id')} c JOIN {_index_alpha_sql('vacancy_id')} v USING (annotator)")
def q_eval_bidirectional(t: Tables) -> DataFrame:
    """Alpha over CVs' lists, over vacancies' lists (the transposed ranks, whose values repeat), and their mean."""
    v = votes(t)
    truth = B.consensus(v)
    by = lambda key, item, name: M.evaluate(M.aligned(v, truth.select("cv_id", "vacancy_id", "rank"), ["annotator", key], item, "rank_no", "rank"), ["annotator"]).select("annotator", F.col("alpha").alias(name))
    d = by("cv_id", "vacancy_id", "c").join(by("vacancy_id", "cv_id", "v"), "annotator")
    return d.select("annotator", F.round("c", 4).alias("cv_alpha"), F.round("v", 4).alias("vacancy_alpha"), F.round((F.col("c") + F.col("v")) / 2, 4).alias("combined_alpha"))


@query(f"SELECT annotator, cv_id, string_agg(p, ',' ORDER BY vacancy_id) AS predicted, min_by(vacancy_id, p) AS top, bool_or(p = 1 AND t = 1) AS correct, round({_RHO}, 4) AS rho FROM {BOTH} GROUP BY annotator, cv_id")
def q_audit(t: Tables) -> DataFrame:
    v = votes(t)
    both = v.join(B.consensus(v), ["cv_id", "vacancy_id"])
    top = both.groupBy("annotator", "cv_id").agg(F.min_by("vacancy_id", "rank_no").alias("top"), F.bool_or((F.col("rank_no") == 1) & (F.col("rank") == 1)).alias("correct"))
    p = F.transform("p", lambda x: x.cast("int").cast("string"))
    return lists(t).select("annotator", "cv_id", F.array_join(p, ",").alias("predicted"), F.round(M.spearman(F.col("p"), F.col("t")), 4).alias("rho")).join(top, ["annotator", "cv_id"])


_AGREE = f"(SELECT a.cv_id, corr(a.rank_no, b.rank_no) AS rho FROM {VOTES} a JOIN {VOTES} b ON a.cv_id = b.cv_id AND a.vacancy_id = b.vacancy_id AND a.annotator = 1 AND b.annotator = 2 GROUP BY a.cv_id HAVING count(*) = 5)"


def agreement(t: Tables) -> DataFrame:
    """``cv_id, rho`` of the first two annotators, on CVs that both ranked."""
    v = votes(t)
    a, b = v.where("annotator = 1"), v.where("annotator = 2")
    both = M.aligned(a.drop("annotator"), b.drop("annotator").withColumnRenamed("rank_no", "other"), ["cv_id"], "vacancy_id", "rank_no", "other")
    return both.where(F.size("p") == 5).select("cv_id", M.spearman(F.col("p"), F.col("t")).alias("rho"))


@query(f"SELECT round(avg(rho), 4) AS mean, round(min(rho), 4) AS lowest, round(max(rho), 4) AS highest, round(stddev_pop(rho), 4) AS deviation, count(*) AS n FROM {_AGREE}")
def q_agreement(t: Tables) -> DataFrame:
    r = F.col("rho")
    return agreement(t).agg(F.round(F.avg(r), 4).alias("mean"), F.round(F.min(r), 4).alias("lowest"), F.round(F.max(r), 4).alias("highest"), F.round(F.stddev_pop(r), 4).alias("deviation"), F.count("*").alias("n"))


@query(f"SELECT CAST(least(15, greatest(1, floor((round(rho, 4) + 1) / (2.0 / 15)) + 1)) AS INTEGER) AS bin, count(*) AS n FROM {_AGREE} GROUP BY 1")
def q_histogram(t: Tables) -> DataFrame:
    """Agreement in 15 bins over -1..1."""
    b = F.least(F.lit(15), F.greatest(F.lit(1), F.floor((F.round("rho", 4) + 1) / (2.0 / 15)) + 1)).cast("int")
    return agreement(t).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT cv_id, vacancy_id, rank_no, round(rank() OVER w + (count(*) OVER (PARTITION BY cv_id, rank_no) - 1) / 2.0, 4) AS average_rank FROM (SELECT DISTINCT cv_id, vacancy_id, rank_no FROM {VOTES}) WINDOW w AS (PARTITION BY cv_id ORDER BY rank_no)")
def q_avg_rank(t: Tables) -> DataFrame:
    d = votes(t).select("cv_id", "vacancy_id", "rank_no").distinct()
    r = F.rank().over(Window.partitionBy("cv_id").orderBy("rank_no")) + (F.count("*").over(Window.partitionBy("cv_id", "rank_no")) - 1) / 2.0
    return d.select("cv_id", "vacancy_id", "rank_no", F.round(r, 4).alias("average_rank"))


@query(f"SELECT cv_id, min_by(vacancy_id, 100 - total_score + vacancy_id * 1e-9) AS best, max(total_score) AS score FROM {PAIRS} GROUP BY cv_id")
def q_argbest(t: Tables) -> DataFrame:
    """Each CV's best vacancy, the lower id at ties: the smallest of (-score, id)."""
    best = F.min(F.struct((-F.col("total_score")).alias("s"), "vacancy_id"))
    return pairs(t).groupBy("cv_id").agg(best.alias("b"), F.max("total_score").alias("score")).select("cv_id", F.col("b.vacancy_id").alias("best"), "score")


_GRID = [(u / s, v / s, b / s) for u in (0.4, 0.5, 0.6) for v in (0.2, 0.3, 0.4) for b in (0.1, 0.2, 0.3) for s in [u + v + b]]
_GRID_SQL = "(VALUES " + ", ".join(f"({i}, {u!r}, {v!r}, {b!r})" for i, (u, v, b) in enumerate(_GRID)) + ") g(grid, u, v, b)"


@query(f"""WITH s AS (SELECT grid, cv_id, t.rank, row_number() OVER (PARTITION BY grid, cv_id ORDER BY round(u * total_score + v * tfidf_score + b * semantic_score, 9) DESC, vacancy_id DESC) AS place
FROM {PAIRS} p JOIN {TRUTH} t USING (cv_id, vacancy_id), {_GRID_SQL})
SELECT CAST(grid AS INTEGER) AS grid, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS accuracy_1, count(*) AS n FROM s WHERE place = 1 GROUP BY grid""")
def q_weight_grid(t: Tables) -> DataFrame:
    """Share of CVs whose best scored vacancy is the consensus' best, for 27 weight sets at once; scored pairs with a consensus."""
    scored = pairs(t).join(B.consensus(votes(t)).select("cv_id", "vacancy_id", "rank"), ["cv_id", "vacancy_id"])
    grid = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(b).alias("b")) for i, (u, v, b) in enumerate(_GRID)])
    each = scored.withColumn("g", F.explode(grid)).withColumn("s", F.round(F.col("g.u") * F.col("total_score") + F.col("g.v") * F.col("tfidf_score") + F.col("g.b") * F.col("semantic_score"), 9))
    best = each.groupBy("g.grid", "cv_id").agg(F.max(F.struct("s", "vacancy_id", "rank"))["rank"].alias("rank"))
    return best.groupBy("grid").agg(F.avg((F.col("rank") == 1).cast("double")).alias("accuracy_1"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT cv_id) AS num_cvs, (SELECT count(DISTINCT vacancy_id) FROM vacancies) AS num_vacancies, min(cv_id) AS first_cv, max(cv_id) AS last_cv FROM cv_data")
def q_metadata(t: Tables) -> DataFrame:
    n = t.vacancies.agg(F.count_distinct("vacancy_id")).scalar()
    return t.cv_data.agg(F.count_distinct("cv_id").alias("num_cvs"), F.min("cv_id").alias("first_cv"), F.max("cv_id").alias("last_cv")).select("num_cvs", n.alias("num_vacancies"), "first_cv", "last_cv")


@query("SELECT round(avg(experience), 6) AS mean, median(experience) AS median, min(experience) AS lowest, max(experience) AS highest, round(stddev_pop(experience), 6) AS deviation, count(experience) AS n FROM (SELECT DISTINCT cv_id, experience FROM cv_data)")
def q_experience_stats(t: Tables) -> DataFrame:
    e = F.col("experience")
    d = t.cv_data.select("cv_id", "experience").distinct()
    return d.agg(F.round(F.avg(e), 6).alias("mean"), F.percentile(e, F.lit(0.5)).alias("median"), F.min(e).alias("lowest"), F.max(e).alias("highest"), F.round(F.stddev_pop(e), 6).alias("deviation"), F.count(e).alias("n"))


@query("""SELECT band, n, round(100.0 * n / sum(n) OVER (), 1) AS percent FROM (SELECT CASE WHEN experience < 3 THEN '<3' WHEN experience < 5 THEN '3-5' WHEN experience < 8 THEN '5-8' ELSE '>=8' END AS band, count(*) AS n
FROM (SELECT DISTINCT cv_id, experience FROM cv_data) WHERE experience IS NOT NULL GROUP BY 1)""")
def q_bands(t: Tables) -> DataFrame:
    e = F.col("experience")
    band = F.when(e < 3, "<3").when(e < 5, "3-5").when(e < 8, "5-8").otherwise(">=8")
    c = t.cv_data.select("cv_id", "experience").distinct().where(e.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
