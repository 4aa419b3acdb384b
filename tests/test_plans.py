"""Plan-shape guards for the headline plans (executed, post-AQE plans)."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

HEADLINE = ["build_profiles", "category_topk", "search", "related", "competitor_rank", "trends_hot",
            "profile_card", "funding_timeline", "doc_profiles", "tree_predict"]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_nested_loops_or_python_udfs(spark, name):
    plan = _plan(spark, name)
    assert not [w for w in FORBIDDEN if w in plan]


def test_topk_is_group_limited(spark):
    assert "WindowGroupLimit" in _plan(spark, "category_topk")


def test_trees_join_is_broadcast(spark):
    plan = _plan(spark, "tree_predict")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
