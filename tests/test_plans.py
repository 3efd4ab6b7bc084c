"""Plans: pruned scans, pushed filters, top-k instead of sorts, no Cartesian products, no Python where none is needed."""

import re

import pytest

from kestrix import catalog

Q = catalog.queries()
PYTHON = {"knn_batch", "beta_interval", "text_hash_vectors", "isotonic_pava", "attention_patterns", "auc_bootstrap_ci", "self_attention_rows"}


def plan(spark, sf, name):
    return Q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_what_it_needs(spark, sf):
    text = plan(spark, sf, "competitive_programs")
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert {c.split(":")[0] for s in read for c in s.split(",")} <= {"l_partkey", "l_returnflag", "p_partkey", "p_brand", "p_type"}
    assert "TakeOrderedAndProject" in text and "partial_count" in text


def test_filters_reach_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderpriority,1-URGENT\)", plan(spark, sf, "match_eq"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,click\)", plan(spark, sf, "count_documents"))


def test_top_k_is_no_full_sort(spark, sf):
    for name in ("find_project_limit", "sort_multi_nulls", "knn_cosine", "youden_threshold"):
        assert "TakeOrderedAndProject" in plan(spark, sf, name)


@pytest.mark.parametrize("name", sorted(set(Q) - {"platt_fit", "irls_fit", "hazard_fit", "embedding_fit", "name_clusters", "spectrum", "ridge_gcv", "hosmer_lemeshow_p"}))
def test_no_cartesian_product_and_no_needless_python(name, spark, sf):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text
    assert name in PYTHON or not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
