"""Queries whose operators must run as many rounds, trees, folds and grid points as they do by default."""

from __future__ import annotations

import inspect

import pytest

import __spark_entry__ as entry
from millrace.operators import clustering, failures, graph, regression, text
from millrace.plans import bindings
from tests.test_workloads import ranks_by_hand, some_edges

SF_DIR = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize("query, module, name, settings", [
    ("pagerank_all_rounds", graph, "pagerank", ["iterations", "checkpoint_every"]),
    ("lda_topics", text, "lda_of", ["iterations", "vocab_size"]),
    ("cv_metrics", failures, "nested_cv", ["grid_depths", "grid_bins", "folds", "iterations"]),
    ("failure_scores", failures, "nested_cv", ["grid_depths", "grid_bins", "folds", "iterations"]),
    ("gbt_regression", regression, "gbt_regression", ["iterations"]),
    ("kmeans_fit", clustering, "kmeans_fit", ["iterations"]),
])
def test_queries_take_the_defaults(spark, monkeypatch, query, module, name, settings):
    signature = inspect.signature(getattr(module, name))

    def stub(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, stub)
    monkeypatch.setattr(bindings, "SELECTED", {})
    monkeypatch.setattr(bindings, "TOPIC_MODELS", {})
    with pytest.raises(Called) as caught:
        entry.queries()[query](spark, SF_DIR)
    assert {s: caught.value.args[0][s] for s in settings} == {s: signature.parameters[s].default for s in settings}


def test_pagerank_of_all_rounds_equals_brute_force(spark):
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(some_edges(), "src string, dst string")).collect()}
    want = ranks_by_hand(some_edges(), 100)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-9) for n in want)
