import random

from braidwork.llm import consensus as A
from braidwork.llm import topn as T


def test_best_vacancies_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        cv = 7 if rng.random() < 0.4 else rng.randint(1, 60)
        s = rng.choice([None, float("nan"), -1.0, 101.0, 100.0, 100.0, 0.0, 50.0, rng.random() * 100])
        rows.append((i, None if rng.random() < 0.01 else cv, rng.randint(1, 40), s, rng.choice([None, "2024-01-01", "2024-01-02"])))
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "x") for r in rows], "result_id long, cv_id long, vacancy_id long, total_score double, scored_at string, place string")
    best = {}
    for i, cv, v, s, at in set(rows):
        if cv is not None and s is not None and s == s and 0 <= s <= 100 and best.get((cv, v), (("", -1),))[0] < (at or "", i):
            best[cv, v] = ((at or "", i), s)
    want = set()
    for cv in {c for c, _ in best}:
        own = sorted(((-s, v) for (c, v), (_, s) in best.items() if c == cv))[:3]
        want |= {(cv, p, v) for p, (_, v) in enumerate(own, 1)}
    assert {tuple(r) for r in T.best_vacancies(df).collect()} == want
    assert T.best_vacancies(df.limit(0)).count() == 0


def test_top_n_outside_the_range_and_with_ties(spark):
    df = spark.createDataFrame([("a", 500.0, 1), ("a", 400.0, 2), ("a", -9.0, 3), ("b", 5.0, 9), ("b", 5.0, 8), ("b", 5.0, 7), (None, 1.0, 1), ("c", None, 1), ("c", float("nan"), 2)], "g string, s double, t int")
    got = {(r.g, r.place, r.t) for r in T.top_n(df, "g", "s", ["t"], 2).collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("b", 1, 7), ("b", 2, 8)}


def test_hot_groups_with_equal_scores(spark):
    """One group has half of all rows, most of them with the highest score; nothing is lost in any salt."""
    rng = random.Random(8)
    rows = [(0 if i % 2 else rng.randint(1, 400), rng.choice([99.5, 99.5, rng.random() * 100]), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g long, s double, t long")
    counts = df.groupBy(df.g.alias("__g")).count().withColumnRenamed("count", "__n")
    hot = {r["__g"]: r["__salts"] for r in T.hot_groups(counts, share=100).collect()}
    assert hot == {0: 51}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, p, t) for p, (_, t) in enumerate(sorted((-s, t) for h, s, t in rows if h == g)[:4], 1)}
    assert {(r.g, r.place, r.t) for r in T.top_n(df, "g", "s", ["t"], 4).collect()} == want


def test_long_tail_and_careless_annotators(spark):
    """Three careless annotators of five outvote the careful in the plain mean; a newcomer with few ballots gets little weight."""
    rng = random.Random(4)
    rows, n = [], 0
    for cv in range(300):
        for a in (1, 2, 11, 12, 13, *([30] if cv < 2 else [])):
            order = [1, 2, 3, 4, 5]
            if a in (11, 12, 13):
                rng.shuffle(order)
            n += 1
            rows += [(n, a, cv, v, r, "2024-01-01") for v, r in enumerate(order, 1)]
    a = spark.createDataFrame(rows, "ballot_id long, annotator int, cv_id long, vacancy_id long, rank_no int, annotated_at string")
    right = lambda t: t.where("consensus_rank = vacancy_id").count()
    truth, weights, _ = A.truth_discovery(a)
    by = {r.annotator: r for r in weights.collect()}
    w = {k: r.weight for k, r in by.items()}
    assert min(w[1], w[2]) > 5 * max(w[11], w[12], w[13])
    assert w[30] < 0.5 * by[30].n_votes / max(by[30].squared_error, 1e-3) and w[1] > 0.8 * by[1].n_votes / max(by[1].squared_error, 1e-3)
    assert right(truth) > 0.97 * 1500 > right(A.plain_consensus(a))


def ballots(cvs=80, annotators=6, seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for cv in range(cvs):
        for a in range(annotators):
            order = [1, 2, 3, 4, 5]
            if a == annotators - 1:
                rng.shuffle(order)
            elif rng.random() < 0.3:
                i = rng.randrange(4)
                order[i], order[i + 1] = order[i + 1], order[i]
            n += 1
            rows += [(n, a, cv, 10 * v, r, "2024-01-01") for r, v in enumerate(order, 1)]
    return rows


def test_careless_annotators_weigh_less(spark):
    a = spark.createDataFrame(ballots(), "ballot_id long, annotator int, cv_id long, vacancy_id long, rank_no int, annotated_at string")
    truth, weights, agreement = A.truth_discovery(a)
    w = {r.annotator: r.weight for r in weights.collect()}
    assert w[5] < 0.3 * min(v for k, v in w.items() if k != 5)
    assert truth.where("consensus_rank * 10 <> vacancy_id").count() <= 0.02 * 400
    assert agreement.count() == 80 and 0 < agreement.agg({"kendall_w": "avg"}).first()[0] <= 1
    equal = A.plain_consensus(a)
    assert equal.columns == ["cv_id", "vacancy_id", "consensus_rank"] and equal.count() == 400


def test_few_votes_mean_a_wide_interval(spark):
    df = spark.createDataFrame([(2.0,), (200.0,)], "n double")
    low = [r.q / r.n for r in df.select("n", A.chi_squared_low(df.n).alias("q")).collect()]
    assert low[0] < 0.1 and 0.75 < low[1] < 0.85  # exact: 0.0253 and 0.8136


def test_invalid_ballots_and_empty_tables(spark):
    rows = ballots(2, 1) + [(900, 8, 0, v, v, None) for v in (1, 2, 3, 4)] + [(901, 9, 0, 1, r, None) for r in (1, 2, 3, 4, 5)] + [(902, 9, 0, None, 1, None), (None, 1, 1, 1, 1, None)]
    a = spark.createDataFrame([(*r, 1) for r in rows], "ballot_id long, annotator int, cv_id long, vacancy_id long, rank_no int, annotated_at string, weight int")
    assert A.plain_consensus(a).count() == 0
    for t in A.truth_discovery(a.limit(0)):
        assert t.count() == 0
