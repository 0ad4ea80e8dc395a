import pytest

from chronoweave import registry

from oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_entry_has_all_core_queries():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(registry.oracle_sql()) <= set(e.oracle_sql())


def test_no_cartesian_products(spark):
    for name in ("flagship_sync", "asof_nearest", "window_range_join", "peaks_prominence"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name, one_row_a_period", [("frame_features", 0), ("kickoff", 4), ("located_features", 0), ("receive_features", 0)])
def test_no_table_of_frames_is_broadcast(spark, name, one_row_a_period):
    """Spark takes exploded frames to be as small as their file, so only a hint keeps them from the driver."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= one_row_a_period
