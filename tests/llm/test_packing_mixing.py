import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.llm import mixing as M
from braidwork.llm import packing as K
from braidwork.llm import tokens as T


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=25))
def test_histogram_is_packed_whole(counts):
    used: dict[int, int] = {}
    for lengths, times in K.pack_histogram(counts, 50):
        assert times > 0 and sum(lengths) <= 50
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def plain(counts, capacity, depth=None):
    """Item by item: the longest first, into the pack with the most room if that takes it."""
    packs: list[list[int]] = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        open_ = [p for p in packs if sum(p) < capacity and (not depth or len(p) < depth)]
        best = min(open_, key=sum, default=None)
        if best is None or sum(best) + x > capacity:
            packs.append([x])
        else:
            best.append(x)
    return sorted(map(tuple, packs))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12), st.sampled_from([None, 1, 2, 3]))
def test_same_sums_as_item_by_item(counts, depth):
    got = K.pack_histogram(counts, 30, depth)
    assert not depth or max((len(p) for p, _ in got), default=0) <= depth
    packs = plain(counts, 30, depth)
    assert sum(n for _, n in got) == len(packs)
    if not depth:
        assert sorted(sum(p) for p, n in got for _ in range(n)) == sorted(map(sum, packs))


def test_the_shortest_pack_comes_first():
    assert sorted(K.pack_histogram({6: 1, 5: 1, 3: 1}, 10)) == [((5, 3), 1), ((6,), 1)]


def test_containers(spark):
    rng = random.Random(1)
    sizes = [rng.choice([17, 17, 17, rng.randint(1, 100), rng.randint(100, 350)]) for _ in range(4000)] + [None, 0, -3]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id long, tokens int, slot int")
    rows = K.pack(df, "doc_id", "tokens", 128).collect()
    full: dict[int, int] = {}
    parts: dict[int, list] = {}
    for r in rows:
        full[r.container_no] = full.get(r.container_no, 0) + r.part_size
        parts.setdefault(r.doc_id, []).append((r.part_no, r.part_size))
    assert max(full.values()) <= 128 and sorted(full) == list(range(len(full)))
    assert len({(r.container_no, r.slot) for r in rows}) == len(rows)
    for i, s in enumerate(sizes):
        own = sorted(parts.get(i, []))
        assert sum(p for _, p in own) == max(0, s or 0) and len(own) == -(-max(0, s or 0) // 128)
    assert sum(full.values()) / (128 * len(full)) > 0.97
    assert K.pack(df.limit(0), "doc_id", "tokens", 128).count() == 0


TARGETS = [("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("none", 0.2, 3), (None, 0.1, 1)]


def mixed(spark, total=None, schedule=None):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "mid", rng.randint(5, 60)) for i in range(3000)] + [(5000 + i, "tiny", rng.randint(5, 60)) for i in range(40)]
    docs += docs[:20] + [(9000, None, 5), (9001, "other", 5), (9002, "big", 0), (9003, "big", None), (None, "big", 9)]
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, source string, tokens int, position double")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return M.mix(d, t, total=total, schedule=schedule)


def test_shares_and_repeats(spark):
    placed, report = mixed(spark)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "mid", "tiny", "none"} and r["none"].actual_share == 0.0
    assert all(abs(r[s].actual_share - w) < 0.01 for s, w in (("big", 0.6), ("mid", 0.3), ("tiny", 0.1)))
    assert all(x.most_repeats <= x.max_repeats for x in r.values()) and r["tiny"].most_repeats == 4
    rows = placed.collect()
    assert len({(x.doc_id, x.copy_no) for x in rows}) == len(rows) and all(0 <= x.position <= 1 for x in rows)
    assert [x.position for x in rows] == sorted(x.position for x in rows)
    late = [x.tokens * (x.position > 0.5) for x in rows if x.source == "tiny"]
    assert sum(late) > 0.55 * sum(x.tokens for x in rows if x.source == "tiny")


def test_schedule_is_followed(spark):
    placed, _ = mixed(spark, schedule={"big": [(0, 1.0), (0.5, 1.0), (0.5000001, 0.0), (1, 0.0)], "mid": [(0, 1), (1, 1)], "tiny": [(0, 1), (1, 1)], "none": [(0, 1), (1, 1)]})
    assert max(r.position for r in placed.collect() if r.source == "big") <= 0.501


def test_larger_total_is_capped(spark):
    _, report = mixed(spark, total=1e9)
    r = {x.source: x for x in report.collect()}
    assert all(r[s].used_tokens == r[s].available_tokens * r[s].max_repeats for s in ("big", "mid", "tiny"))


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, tokens int")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    placed, report = M.mix(d, t)
    assert placed.count() == 0 and {x.actual_share for x in report.collect()} == {0.0}
    placed, report = M.mix(d, t.limit(0))
    assert placed.count() == 0 and report.count() == 0


@pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("x " * 30_000,)], "t string")
    n = [r.n for r in df.select(T.token_count(F.col("t")).alias("n")).collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 1 and n[4] >= 30_000


def test_too_many_kinds_of_containers_are_an_error(spark, tmp_path):
    from braidwork.llm import queries

    spark.createDataFrame([(1, "a", "some text")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"k{i}", 100) for i in range(101)], "container_kind string, capacity_tokens int").write.parquet(f"{tmp_path}/containers.parquet")
    with pytest.raises(ValueError, match="more than 100 kinds"):
        queries.p7_pack(spark, str(tmp_path))
