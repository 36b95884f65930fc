"""Physical-plan properties that matter at scale."""

import pytest

from litspark.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, (fn, _) in all_queries().items()}
#: Queries whose plan needs fitted models first.
FITS = {"lda_topics", "select_k", "lda_vocabulary", "lda_invariants", "select_k_invariants"}


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_assignment_does_not_shuffle_documents(spark):
    p = plan(spark, "assign_topic")
    assert "Exchange" not in p and "Join" not in p


def test_top_k_per_topic_limits_before_the_shuffle(spark):
    p = plan(spark, "top_terms_per_topic")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_aggregates_are_partial_before_exchange(spark):
    p = plan(spark, "topic_distribution")
    assert "HashAggregate" in p and "partial_count" in p


def test_dedup_sorts_digests_and_limits_before_the_shuffle(spark):
    p = plan(spark, "dedup_rows")
    assert "SortAggregate" not in p and p.count("WindowGroupLimit") == 2
    assert all("_digest" in line for line in p.splitlines() if " Sort [" in line)


def test_scan_prunes_columns(spark):
    p = plan(spark, "clean_html")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
