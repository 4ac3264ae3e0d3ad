"""Plan rules every registry query must keep: no cartesian or nested-loop
joins, no Python evaluation nodes, and scans read only needed columns."""

import pytest

from vellum.plans.registry import QUERIES as REGISTERED

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonUDF"]


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_plan_rules(spark, name):
    df = REGISTERED[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"


def test_text_columns_are_pruned(spark):
    # the manifest derivation joins documents but must never read its text
    plan = REGISTERED["manifest_derive"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" in plan
    for line in plan.splitlines():
        if "documents.parquet" in line:
            assert "text:string" not in line


def test_ledger_table_prunes_partitions(spark):
    """A ledger stored by create_ledger is partitioned by database and table:
    per-table audit and replay reads prune to that table's folders."""
    from vellum.operators import audit
    from vellum.operators.replay import _usable
    from vellum.plans import fixtures as fx
    from vellum.session import scratch_dir
    from vellum.sinks.ledger_store import create_ledger
    loc = scratch_dir(spark, "ledger-plan")
    name = "ledger_plan_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    fx.ledger(spark, SF).select(*spark.table(name).columns).write.insertInto(name)
    led = spark.table(name)
    for df in [audit.field_changed(led, "customer", "segment"),
               _usable(led, "customer", "main")]:  # the ledger read replay aggregates
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(table_name" in plan or "PartitionFilters: [isnotnull(database_name" in plan
        assert "= customer)" in plan
