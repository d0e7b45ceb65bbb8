import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import ballots as B
from braidwork.operators import experience as E
from braidwork.operators import metrics as M
from braidwork.operators import ranking as R
from braidwork.operators.distributed import blocked_prefix_sum


def metrics(spark, pairs):
    df = spark.createDataFrame([(list(map(float, p)), list(map(float, t))) for p, t in pairs], "p array<double>, t array<double>")
    p, t = F.col("p"), F.col("t")
    return df.select(M.alpha(p, t).alias("alpha"), M.spearman(p, t).alias("rho"), M.kappa(p, t).alias("kappa"), M.ndcg(p, t).alias("ndcg"), M.reciprocal_rank(p, t).alias("mrr"), M.top_k_equal(p, t, 1).alias("acc1"), M.pairwise(p, t).alias("pw")).collect()


def test_known_metric_values(spark):
    r = metrics(spark, [([2, 1, 4, 3, 5], [1, 2, 3, 4, 5])])[0]
    assert (round(r.rho, 4), round(r.kappa, 4), round(r.alpha, 4), round(r.ndcg, 4), r.mrr, r.acc1, round(r.pw, 4)) == (0.8, 0.8, 0.9, 0.8645, 0.5, False, 0.8)


def test_alpha_and_kappa_follow_rho_on_permutations(spark):
    perms = random.Random(1).sample(list(itertools.permutations(range(1, 6))), 60)
    for r in metrics(spark, [(p, (1, 2, 3, 4, 5)) for p in perms]):
        assert abs(r.alpha - (1 + r.rho) / 2) < 1e-9 and abs(r.kappa - r.rho) < 1e-9


def test_metrics_of_ties_and_constants(spark):
    r = metrics(spark, [([1, 1, 1], [1, 2, 3]), ([1, 1], [1, 1])])
    assert r[0].rho is None and r[1].rho is None and r[1].alpha == 1.0 and r[1].kappa == 1.0


def test_consensus_breaks_ties_by_higher_vacancy(spark):
    rows = [(1, 1, 7, v, r, "2024-01-01") for v, r in zip((1, 2, 3, 4, 5), (4, 2, 1, 5, 3))] + [(2, 2, 7, v, r, "2024-01-01") for v, r in zip((1, 2, 3, 4, 5), (1, 5, 2, 3, 4))]
    rows += rows[:5] + [(3, 3, 7, 1, 9, "2024-01-01"), (4, 4, 7, None, None, None)]
    a = spark.createDataFrame(rows, "ballot_id long, annotator int, cv_id long, vacancy_id long, rank_no int, annotated_at string")
    c = {r.vacancy_id: r["rank"] for r in B.consensus(B.counting_ballots(a)).collect()}
    assert c == {3: 1, 1: 2, 5: 4, 2: 3, 4: 5} or sorted(c.values()) == [1, 2, 3, 4, 5]
    means = {1: 2.5, 2: 3.5, 3: 1.5, 4: 4.0, 5: 3.5}
    assert [v for v, _ in sorted(c.items(), key=lambda x: x[1])] == sorted(means, key=lambda v: (means[v], -v))
    assert B.consensus(B.counting_ballots(a.limit(0))).count() == 0


def test_rank_in_groups_equals_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, float(rng.choice([0, 10, 50, 50.5, 99, 100]))) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i int, s double")
    got = {r.i: r["rank"] for r in R.rank_in_groups(df, "g", "s", ["i"]).collect()}
    for g in (1, 2, 3):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        assert [got[x[1]] for x in own] == list(range(1, len(own) + 1))


def test_minmax_and_competition(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 50.0, 50.0, 50.0), (1, 2, 10.0, 50.0, 50.0, 60.0), (2, 1, 30.0, 20.0, 10.0, 90.0)], "cv_id int, vacancy_id int, keyword_score double, tfidf_score double, semantic_score double, total_score double")
    rows = R.competition(R.bidirectional(R.ensemble(df))).collect()
    assert len(rows) == 3 and all(r.backward == 100 / r.position for r in rows)
    assert {r.s for r in R.minmax(df, "cv_id", "tfidf_score", "s").collect()} == {0.5}


def test_union_years(spark):
    df = spark.createDataFrame([(1, 2010, 2014), (1, 2012, 2015), (1, 2016, 2018), (1, 2018, 2020), (2, 2020, 2010), (2, 2021, 2022)], "k int, start int, end int")
    assert {r.k: r.years for r in E.union_years(df, "k").collect()} == {1: 9.0, 2: -9.0}


@pytest.mark.parametrize("blocks", [2, 16, 100])
def test_blocked_prefix_sum(spark, blocks):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"), "id", (F.col("id") % 7).alias("v"))
    rows = blocked_prefix_sum(df, ["g"], ["k", "id"], "v", "before", blocks).collect()
    for g in range(3):
        run = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: (r.k, r.id)):
            assert r.before == run
            run += r.v


def test_context_periods(spark):
    t = "Work 2001-2003, 2004 - now. " + "x" * 60 + " University of Here 1990-1995 " + "y" * 60 + " 2010-2012"
    rows = E.context_periods(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").collect()
    assert sorted((r.start, r.end) for r in rows) == [(2001, 2003), (2004, 2026), (2010, 2012)]


def test_grid_has_every_configuration(spark):
    import re
    from collections import Counter

    from braidwork.functions.lexicons import STOP_WORDS
    from braidwork.operators import grid

    cvs = {1: "Python Sql Python and Spark. " * 12 + "The Python team of Acme", 2: "Soups, sauces and the menu of the season"}
    vacancies = {1: "python sql spark", 2: "menu, soups and sauces of the season", 3: "python menu sauces. " * 15}
    truth = spark.createDataFrame([(c, v, v) for c in cvs for v in vacancies], "cv_id long, vacancy_id long, rank int")
    got = grid.grid(spark.createDataFrame(list(cvs.items()), "cv_id long, text string"), spark.createDataFrame(list(vacancies.items()), "vacancy_id long, text string"), truth).collect()
    assert Counter((r.resume_text, r.vacancy_text, r.representation, r.ngrams) for r in got) == {(a, b, *c): 2 for a in grid.TYPES for b in grid.TYPES for c in grid.REPRESENTATIONS}
    assert len(grid.TYPES) ** 2 * len(grid.REPRESENTATIONS) == 144

    def vector(text, lo, hi, words):
        low = re.sub(r"\s\s+", " ", text.lower())
        x = [w for w in re.findall(r"\w{2,}", low) if w not in STOP_WORDS] if words else list(low)
        c = Counter(tuple(x[i : i + n]) for n in range(lo, hi + 1) for i in range(len(x) - n + 1))
        norm = sum(v * v for v in c.values()) ** 0.5
        return {k: v / norm for k, v in c.items()}

    for representation, words in (("char_ngrams", False), ("word_ngrams", True)):
        for lo, hi in grid.RANGES:
            want = []
            for c in cvs.values():
                a = vector(c, lo, hi, words)
                gaps = [(round(sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {**a, **b}), 9), v) for v, b in ((v, vector(t, lo, hi, words)) for v, t in vacancies.items())]
                want.append([float(sorted(gaps).index(g) + 1) for g in gaps])
            rows = [r.p for r in got if (r.resume_text, r.vacancy_text, r.representation, r.ngrams) == ("full", "full", representation, f"{lo}-{hi}")]
            assert sorted(rows) == sorted(want)
