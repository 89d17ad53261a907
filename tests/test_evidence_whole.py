"""The evidence queries examine every claim and every citation, also beyond the budgets of the counting queries."""

from collections import Counter

import pytest
from docsieve.plans import claim_queries
from test_review import SOURCE, support

WHOLE = {"statistical_threshold_uncertainty": 1100, "statistical_average_inconsistency": 1100, "citation_direction_conflict_candidate": 30, "citation_numeric_mismatch_candidate": 24, "data_not_directly_available": 1, "cross_condition_subject_mismatch": 2}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One order of 1,100 lines, one paper of 210 blocks, no measurement with two conditions."""
    d = tmp_path_factory.mktemp("whole")
    spark.range(1100).selectExpr("1L AS l_orderkey", "1 AS l_linenumber", "CAST(100 + id AS DECIMAL(15,2)) AS l_quantity", "0L AS l_suppkey", "id AS l_partkey").write.parquet(f"{d}/lineitem.parquet")
    spark.range(1, 211).selectExpr("id AS o_orderkey", "156L AS o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(1).selectExpr("id AS p_partkey", "'b' AS p_brand", "5 AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(4).selectExpr("id AS c_custkey", "1 AS c_nationkey", "'S' AS c_mktsegment").write.parquet(f"{d}/customer.parquet")
    return str(d)


def test_citations_without_a_budget_are_compared_once_for_equal_contexts(spark):
    texts = ["The machine output increased to 13 units [1].", "The machine output decreased to 12 units [1].", "Weather stayed calm [1, 2].", "The machine output increased [9]."] * 20
    sources = {1: SOURCE, 2: ["The machine output increased to 30 units."]}
    columns = ["block_idx", "ctx", "comparisons", "outcome", "score", "missing", "best"]
    whole = support(spark, texts, sources, budget=None).select(*columns).collect()
    assert Counter(r.outcome for r in whole) == {"numeric": 20, "direction": 20, "unaligned": 20, "no_source": 20} and sum(r.comparisons for r in whole) == 20 * (2 + 2 + 3)
    assert sorted(map(str, whole)) == sorted(map(str, support(spark, texts, sources, budget=10**6).select(*columns).collect()))


def test_evidence_examines_everything(spark, tables):
    assert Counter(r.code for r in claim_queries.evidence(spark, tables).collect()) == WHOLE


def test_listing_holds_everything(spark, tables):
    got = claim_queries.evidence_order(spark, tables).collect()
    assert sorted((r.document_id, r.place) for r in got) == [(d, i) for d, n in (("nation-1", 3), ("order-1", 2200), ("paper-0", 54)) for i in range(1, n + 1)]


def test_rerun_counts_everything(spark, tables):
    expected = {(c, c.startswith("citation"), False): n for c, n in WHOLE.items()} | {("data_not_directly_available", True, True): 1}
    assert {(r.code, r.again, r.next): r.n for r in claim_queries.evidence_rerun(spark, tables).collect()} == expected
