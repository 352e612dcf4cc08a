"""Plan shape of every registered query: no cartesian product and no
nested-loop join anywhere; top-k queries plan a WindowGroupLimit."""

import pytest

import __spark_entry__ as E

TOPK = ["bm25_topk", "cascade_topk", "knn_l2", "dense_dot_scores", "hybrid_topk", "topk_per_prefix",
        "prefix_index", "cap_postings"]


@pytest.fixture(scope="module")
def plans(spark, sf):
    out = {}
    for k, fn in E.queries().items():
        if k in ("train_reranker", "feature_importance", "rerank_topk", "explain_prefix", "model_metadata",
                 "model_split_metrics"):
            continue  # these fit a model while building the plan; not checked here
        out[k] = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_or_nested_loop(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_topk_queries_use_window_group_limit(plans):
    assert [k for k in TOPK if "WindowGroupLimit" not in plans[k]] == []
