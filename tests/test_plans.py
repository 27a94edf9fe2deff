"""Scale guards on physical plans: no cartesian or nested-loop joins, and
no Python at all, in the result and in every stage written before it."""

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

NAMES = ["default_rate_by_income_group", "null_report", "categorical_describe", "clean_loans", "corr_matrix",
         "class_counts", "pair_bins", "standard_scale", "roc_points", "roc_auc", "silhouette_sq", "inertia",
         "score_applications", "smote"]
BAD = ("BroadcastNestedLoopJoin", "CartesianProduct")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "FlatMapGroupsInArrow")


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name, monkeypatch):
    """The plan of the result and of every stage table written on the way."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def recorded(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    df = entry.queries()[name](spark, SF_SMALL)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert not any(b in plan for b in BAD), name
        assert not any(p in plan for p in PYTHON), name


def test_scan_prunes_columns(spark):
    df = entry.queries()["duplicate_count"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
