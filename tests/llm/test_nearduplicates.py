import random

import pytest

from braidwork.llm import nearduplicates as N


def texts(seed=1, groups=25, versions=4, words=60, edits=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = [rng.choice(vocabulary) for _ in range(20)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)] + boiler
        for _ in range(versions):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [t[i], rng.choice(vocabulary)]])
            out.append(" ".join(t))
    return out


def brute(rows, k, threshold):
    def shingles(t):
        w = N.WORD.findall(t.lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(s, i, shingles(t)) for s, i, t in rows if t and shingles(t)]
    return {(s, min(i, j), max(i, j)) for n, (s, i, a) in enumerate(sets) for r, j, b in sets[n + 1 :] if s == r and i != j and len(a & b) >= threshold * len(a | b)}


@pytest.mark.parametrize("k, threshold", [(3, 0.5), (5, 0.8)])
def test_equals_brute_force(spark, k, threshold):
    rows = [(i % 2, i, t) for i, t in enumerate(texts(edits=12 if threshold == 0.5 else 2))]
    rows += [(0, 1000, rows[0][2]), (0, 1001, rows[0][2]), (0, 1002, None), (0, 1003, ""), (0, 1004, "two words"), rows[3], (1, None, "a b c d e f")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "space int, id long, text string, path string")
    links, members = N.similar_sets(df, k, threshold)
    got = {tuple(r) for r in N.expand(links, members).collect()}
    want = brute(sorted({r for r in rows if r[1] is not None}), k, threshold)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 20


def test_small_buckets_force_recursion_and_blocks(spark):
    rows = [(0, i, t) for i, t in enumerate(texts(seed=4, groups=3, versions=25))]
    docs = spark.createDataFrame(rows, "space int, id long, text string")
    sigs = N.signatures(docs, 3)
    found = {(r.id_a, r.id_b) for r in N.candidates(sigs, 0.5, limit=4, depth=3).collect()}
    want = {(a, b) for _, a, b in brute(rows, 3, 0.5)}
    same = {(a, b) for a, b in want if rows[a][2] == rows[b][2]}
    assert len((want - same) - found) <= 0.02 * len(want)


def test_recall_at_the_threshold_where_every_bucket_is_split_to_the_last_depth(spark):
    pairs = 6000
    rows = [(0, 2 * p + side, " ".join([f"p{p}c{i}" for i in range(40)] + [f"p{p}s{side}x{i}" for i in range(20)])) for p in range(pairs) for side in (0, 1)]
    sigs = N.materialize(N.signatures(spark.createDataFrame(rows, "space int, id long, text string").repartition(4), 1))
    found = {(r.id_a, r.id_b) for r in N.candidates(sigs, 0.5, recall=0.995, limit=1, depth=6).collect()}
    assert len(found & {(2 * p, 2 * p + 1) for p in range(pairs)}) >= (0.995 - 3 * 0.0009) * pairs


def test_many_copies_are_linked_to_one(spark):
    docs = spark.createDataFrame([(0, i, "same five words in here") for i in range(30)], "space int, id long, text string")
    links, members = N.similar_sets(docs, 3, 0.5)
    assert links.count() == 0 and N.expand(links, members).count() == N.expand(links, members, block=7).count() == 30 * 29 // 2


def test_pairs_of_a_large_group_are_all_given(spark):
    n = 1100  # one set of shingles in different texts, and a record that is similar to all of them
    rows = [(0, i, ("Same" if i % 2 else "same") + " five words in here" + "!" * (i % 7)) for i in range(n)] + [(0, n, "same five words in here too")]
    links, members = N.similar_sets(spark.createDataFrame(rows, "space int, id long, text string"), 3, 0.5)
    got = N.expand(links, members, block=100)
    assert got.count() == got.distinct().count() == n * (n + 1) // 2 and got.where("id_a >= id_b").isEmpty()
    assert N.expand(links, members).count() == n * (n + 1) // 2


def test_groups_are_connected_components(spark):
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 8, 9)], "space int, id_a long, id_b long")
    members = spark.createDataFrame([(0, i, i) for i in (1, 2, 3, 4, 5, 8, 9, 20)] + [(0, 21, 20)], "space int, id long, class_id long")
    got = {r.id: (r.group_id, r.n_links) for r in N.groups(links, members).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 2), 5: (1, 1), 8: (8, 1), 9: (8, 1), 20: (20, 0), 21: (20, 0)}


def test_empty(spark):
    docs = spark.createDataFrame([], "space int, id long, text string")
    links, members = N.similar_sets(docs)
    assert links.count() == 0 and members.count() == 0 and N.groups(links, members).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(0, 1, long), (0, 2, long + " end")], "space int, id long, text string")
    links, members = N.similar_sets(docs, 3, 0.5)
    assert [tuple(r) for r in links.collect()] == [(0, 1, 2)]


def test_long_chains_reach_one_group(spark):
    """300 links in a row, and more copies of one set than any bound that there was."""
    links = spark.createDataFrame([(0, i, i + 1) for i in range(300)], "space int, id_a long, id_b long")
    members = spark.createDataFrame([(0, i, i) for i in range(301)] + [(0, 1000 + i, 300) for i in range(1500)] + [(1, 5, 5)], "space int, id long, class_id long")
    got = {(r.space, r.id): (r.group_id, r.n_links) for r in N.groups(links, members).collect()}
    assert len(got) == 1802 and {g for (s, _), (g, _) in got.items() if s == 0} == {0}
    assert got[0, 0] == (0, 1) and got[0, 7] == (0, 2) and got[0, 1300] == (0, 1) and got[1, 5] == (5, 0)
