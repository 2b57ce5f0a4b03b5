"""What the driver holds: no relation of a row per script or job may reach it as a broadcast, and no plan of all detectors at once."""

from __future__ import annotations

from loomgraph.functions import scratch
from loomgraph.operators import graph, scripts
from loomgraph.plans import detection, registry
from loomgraph.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaned_without_joins(spark):
    """a cursor's target comes from the text of its own row."""
    body = "CURSOR c IS SELECT a FROM s; CURSOR d IS SELECT b FROM s; CURSOR e IS SELECT c FROM s; BEGIN UPDATE t1 SET x = 1; INSERT INTO t2 SELECT D, cx; f(c); n; n; n; n; UPDATE t3 SET a = c; OPEN e FOR SELECT 2 FROM q;"
    df = spark.createDataFrame([(1, body), (2, "OPEN z FOR SELECT 3 FROM r;"), (3, ""), (4, None)], "script long, body string")
    found = scripts.cursor_sources(df)
    assert sorted((r.script, r.cursor, r.query, r.target) for r in found.where("script = 1").collect()) == [(1, "C", "SELECT a FROM s", "T1"), (1, "D", "SELECT b FROM s", "T1"), (1, "E", "SELECT 2 FROM q", "T2"), (1, "E", "SELECT c FROM s", "T3")]
    assert [(r.cursor, r.query, r.target) for r in found.where("script = 2").collect()] == [("Z", "SELECT 3 FROM r", None)]
    assert "Join" not in plan_of(scripts.cleaned(df))


def test_all_findings_in_small_plans(spark):
    """each detector's counts are written before the next is planned, so the rest is a union of files."""
    registry.queries()
    plan = plan_of(registry.DEFINED["f28_all_findings"](Fixtures(spark, SF)))
    assert "Join" not in plan and "Aggregate" not in plan
    assert plan.count("FileScan parquet") == len(detection.DETECTORS)


def test_names_in_a_small_plan(spark):
    """the tests of names are not repeated on the expressions that names come from (37 MB of plan before)."""
    registry.queries()
    assert len(plan_of(registry.DEFINED["f23_intermediate_names"](Fixtures(spark, SF)))) < 1_000_000


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """relations of a row per job, and what is written of them, are joined by a shuffle even if their files look small."""
    jobs = spark.createDataFrame([(i, False, False) for i in range(6)], "job long, is_pass boolean, is_stop boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 2)], "job long, dependent_job long")
    depth = graph.weighted_depth(edges, jobs, spark.createDataFrame([(0,)], "root_job long"))
    assert "BroadcastHashJoin" not in plan_of(depth)
    assert sorted((r.node, r.depth) for r in depth.collect()) == [(0, 0), (1, 1), (2, 2), (3, 1)]
    nodes = depth.selectExpr("'R' as rpt", "node", "depth", "0 as rank")
    found = graph.execution_order(nodes, edges.selectExpr("'R' as rpt", "job as source", "dependent_job as target"))
    assert sorted((r.step, r.node) for r in found.collect()) == [(1, 0), (2, 1), (3, 3), (4, 2)]
    monkeypatch.setattr(scratch, "LARGE", 0)
    assert "SortMergeJoin" in plan_of(jobs.join(scratch.materialize(edges, "edges"), "job"))
