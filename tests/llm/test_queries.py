"""Every query of the training-data operations over the smallest tables: against its SQL, or by what must hold."""

import math
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from braidwork.llm import queries as Q
from braidwork.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the test tables")


def plain(x):
    return round(x, 5) if isinstance(x, float) and not math.isnan(x) else x


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = Q.QUERIES[name](spark, DATA).toPandas()
        return done[name]

    return get


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows_as_the_sql(sql, result, name):
    got, want = result(name), sql.sql(Q.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(plain(x) for x in r) for r in d[columns].itertuples(index=False, name=None)), key=repr) for d in (got, want)]
    assert rows[0] == rows[1]


def test_values_are_mapped_or_reported(result, spark):
    found, open_ = result("p1_found"), result("p1_unmatched")
    assert not found.duplicated().any() and len(found) > 1000
    assert open_["n_records"].sum() == (found["catalog_id"] == 0).sum()
    names = {r.canonical for r in table(spark, DATA, "catalog_entries").collect()}
    assert not names & set(found.loc[found.field_name != "job_title", "raw_value"]) & {n for n in names if n.islower()}


def test_groups_hold_the_links(result):
    links, groups = result("p2_found"), result("p2_groups")
    of = {(r.record_table, r.record_id): r.group_id for r in groups.itertuples()}
    assert len(of) == len(groups) and all(of[r.record_table, r.id_a] == of[r.record_table, r.id_b] for r in links.itertuples())


def test_segments_and_wrong_labels(result):
    found, segments = result("p4_found"), result("p4_segments")
    assert set(found.lang) <= {"en", "de", "fr", "es", "pt", "ru"} and segments.confidence.between(0, 1).all()
    every = {tuple(r) for r in segments[["record_table", "record_id", "segment_no", "lang"]].itertuples(index=False)}
    assert {tuple(r) for r in found.itertuples(index=False)} <= every


def test_personal_data_stands_in_the_text_and_goes(result, spark):
    found, clean = result("p5_found"), result("p5_redacted")
    texts = {}
    for r in table(spark, DATA, "cv_data").select("cv_id", "text").collect():
        texts.setdefault(r.cv_id, []).append(r.text or "")
    assert set(found.pii_type) == {"person_name", "email", "phone", "id_number", "street_address"} and not found.duplicated().any()
    assert all(any(r.pii_text in t for t in texts[r.cv_id]) for r in found.itertuples())
    holes = re.compile(r"\[(?:PERSON_NAME|EMAIL|PHONE|ID_NUMBER|STREET_ADDRESS)\]")
    for r in clean.itertuples():
        kept = [p for p in holes.split(r.text or "") if p]
        assert any(all(p in t for p in kept) for t in texts[r.cv_id])


def test_containers_are_full_and_whole(result, spark):
    packed = result("p7_pack")
    capacity = {r.container_kind: r.capacity_tokens for r in table(spark, DATA, "containers").collect()}
    sizes = {r.doc_id: r.tokens for r in Q._sized(spark, DATA).collect()}
    for kind, own in packed.groupby("container_kind"):
        used = own.groupby("container_no").part_size.sum()
        assert used.max() <= capacity[kind] and sorted(used.index) == list(range(len(used)))
        assert own.groupby("doc_id").part_size.sum().to_dict() == {d: n for d, n in sizes.items() if n}
        parts = own.groupby("doc_id").part_no.count()
        assert all(n == -(-sizes[d] // capacity[kind]) for d, n in parts.items())
        assert used.sum() >= 0.9 * capacity[kind] * (len(used) - 1)


def test_shares_and_repeats(result, spark):
    mixed, shares = result("p8_mix"), result("p8_shares")
    most = {r.source: r.max_repeats for r in table(spark, DATA, "mix_targets").collect()}
    assert all(n <= most[s] for (s, _), n in mixed.groupby(["source", "doc_id"]).size().items())
    assert abs(shares.actual_share.sum() - 1) < 1e-6


def test_damaged_documents_are_restored(result, spark):
    found, restored = result("p9_found"), result("p9_restored")
    assert sorted(found.doc_id) == sorted(restored.doc_id) and not found.duplicated().any() and len(found)
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").where(F.col("text").isNotNull()).collect()}
    changed = [r for r in restored.itertuples() if r.restored != texts[r.doc_id]]
    assert len(changed) > 0.5 * len(restored)
