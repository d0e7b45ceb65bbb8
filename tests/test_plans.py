"""Plans: no Cartesian products, scans read only the columns that are used."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CHEAP = [n for n in entry.queries() if n.startswith("q_") and n not in ("q_vm_grid",)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_cartesian_product(spark, name):
    p = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in p
    # the only joins without a key: every row with one broadcast row that holds the labels' centroids
    assert "BroadcastNestedLoopJoin" not in p or name in ("q_semantic_chunked", "q_most_similar")


def test_scans_are_pruned_and_filters_pushed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    p = plan(entry.queries()["q_rank_unified"](spark, DATA))
    schema = re.search(r"ReadSchema: struct<([^>\n]*)", p).group(1)
    assert "matched_skills" not in schema and "vacancy_title" not in schema and "IsNotNull(total_score)" in p
    p = plan(entry.queries()["q_experience_stats"](spark, DATA))
    assert re.search(r"ReadSchema: struct<cv_id:bigint,experience:double>", p)
