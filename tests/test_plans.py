"""Physical-plan assertions over the registered queries:
no cartesian / nested-loop joins anywhere, and no Python execution node
outside the operators that use Arrow batches on purpose."""

import pytest

from tessera.plans.registry import all_queries

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow",
                "FlatMapGroupsInPandas", "PythonMapInArrow"]
# Operators that run Python in Arrow-batched tasks by design.
PYTHON_ALLOWED = {"point_in_polygon_counts", "inside_any_zone", "knn_regress", "contingency_cells",
                  "isolation_fixed_forest",
                  "isolation_forest", "outliers_vote_forest", "outliers_by_category_forest",
                  "permutation_importance", "importance_compare", "prepared_dataset",
                  "training_report"}
SKIP = {"training_report", "prepared_dataset", "hyperparameter_search", "baseline_cv",
        "ensembles", "timeseries_cv", "sampled_shap", "permutation_importance", "importance_compare"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in all_queries() if n not in SKIP))
def test_plan_shape(spark, name):
    df = all_queries()[name].fn(spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert not [n for n in PYTHON_NODES if n in plan], plan


# Per-key work must aggregate and join back rather than window over raw keys
# (a window puts every row of a hot key in one task).
NO_WINDOW = ["price_redistribution", "coherent_groups", "target_encode_crossfit",
             "target_encode_transform", "outliers_by_category", "category_counts_wide",
             "exclude_incomplete_groups", "state_value_join", "temporal_split", "random_split"]


@pytest.mark.parametrize("name", NO_WINDOW)
def test_no_window_over_data_keys(spark, name):
    plan = _plan(all_queries()[name].fn(spark, "/root/testdata/sf0.001"))
    assert "Window [" not in plan and "WindowGroupLimit" not in plan, plan
