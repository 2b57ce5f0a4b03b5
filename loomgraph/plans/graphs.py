"""Graph queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.columns import joined
from loomgraph.functions.numbering import numbered
from loomgraph.operators import graph

from .registry import query

_DEPTH = """
WITH RECURSIVE r(root, node, depth) AS (
  SELECT DISTINCT root_job, root_job, 0 FROM fx_roots
  UNION
  SELECT r.root, e.{to}, r.depth + CASE WHEN n.is_pass THEN 0 ELSE 1 END
  FROM r JOIN fx_edges e ON e.{frm} = r.node JOIN fx_jobs n ON n.job = e.{to} WHERE NOT n.is_stop)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN fx_jobs n ON n.job = r.node
WHERE (r.node = r.root OR NOT n.is_pass) {more} GROUP BY root, node
"""


@query("g01_backward_depth", _DEPTH.format(frm="job", to="dependent_job", more=""))
def g01(fx):
    """Depth of all jobs upstream of each report root."""
    return graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"])


@query("g02_forward_depth", _DEPTH.format(frm="dependent_job", to="job", more="AND r.node <> r.root").replace("root_job, root_job, 0 FROM fx_roots", "job, job, 0 FROM fx_jobs"))
def g02(fx):
    """Depth of all consumers of a job, itself left out."""
    starts = fx["fx_jobs"].select(F.col("job").alias("root_job"))
    return graph.weighted_depth(graph.reversed_edges(fx["fx_edges"]), fx["fx_jobs"], starts).where("node <> root")


@query("g03_node_rollup", """
SELECT object AS node, arg_min(tgt_table, pos) AS first_table, count(*) AS n_rows, count(DISTINCT src_table) AS n_sources,
       string_agg(DISTINCT upper(tgt_table), ',' ORDER BY upper(tgt_table)) AS tables FROM fx_lineage GROUP BY object
""")
def g03(fx):
    """One row per node: scalars of its first row, sets of its tables."""
    return fx["fx_lineage"].groupBy(F.col("object").alias("node")).agg(
        F.min_by("tgt_table", "pos").alias("first_table"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("src_table").alias("n_sources"), joined(F.collect_set(F.upper("tgt_table"))).alias("tables")
    )


def scoped_edges(edges, nodes):
    """Edges whose ends both belong to the report; they point from the producer to the consumer."""
    one, two = (nodes.select("rpt", F.col("node").alias(c)).hint("merge") for c in ("source", "target"))
    return edges.select(F.col("dependent_job").alias("source"), F.col("job").alias("target")).join(one, "source").join(two, ["rpt", "target"]).select("rpt", "source", "target")


def report_nodes(fx):
    depth = graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"])
    return depth.join(fx["fx_roots"], depth["root"] == fx["fx_roots"]["root_job"]).select("rpt", "node", "depth")


_NODES = _DEPTH.format(frm="job", to="dependent_job", more="").strip().removeprefix("WITH RECURSIVE ").split("\nSELECT root, node, CAST(min")
_NODE_CTE = f"WITH RECURSIVE {_NODES[0]}, d AS (SELECT root, node, CAST(min{_NODES[1]}), nodes AS (SELECT rpt, node, depth FROM d JOIN fx_roots ON root = root_job)"


@query("g04_scoped_edges", _NODE_CTE + " SELECT a.rpt, e.dependent_job AS source, e.job AS target FROM fx_edges e JOIN nodes a ON a.node = e.dependent_job JOIN nodes b ON b.rpt = a.rpt AND b.node = e.job")
def g04(fx):
    return scoped_edges(fx["fx_edges"], report_nodes(fx))


@query("g05_overlap_edges", "SELECT DISTINCT w.job AS producer, r.job AS consumer FROM fx_writes w JOIN fx_reads r ON w.tbl = r.tbl JOIN fx_jobs n ON n.job = r.job WHERE w.job <> r.job AND n.category = 'MV'")
def g05(fx):
    """Edges by table overlap from producers to view-like consumers."""
    views = fx["fx_jobs"].where("category = 'MV'").select(F.col("job").alias("consumer"))
    reads = fx["fx_reads"].select(F.col("job").alias("consumer"), "tbl").join(views, "consumer", "left_semi")
    return fx["fx_writes"].select(F.col("job").alias("producer"), "tbl").join(reads, "tbl").where("producer <> consumer").select("producer", "consumer").distinct()


@query("g06_cross_report", _NODE_CTE + " SELECT node, count(DISTINCT rpt) AS n_reports, count(DISTINCT rpt) > 1 AS cross_report FROM nodes GROUP BY node")
def g06(fx):
    """In how many reports a job appears."""
    n = F.count_distinct("rpt")
    return report_nodes(fx).groupBy("node").agg(n.alias("n_reports"), (n > 1).alias("cross_report"))


@query("g07_producers_consumers", """
SELECT tbl, coalesce(string_agg(DISTINCT CASE WHEN kind = 'w' THEN lpad(CAST(job AS VARCHAR), 9, '0') END, ',' ORDER BY CASE WHEN kind = 'w' THEN lpad(CAST(job AS VARCHAR), 9, '0') END), '') AS producers,
       coalesce(string_agg(DISTINCT CASE WHEN kind = 'r' THEN lpad(CAST(job AS VARCHAR), 9, '0') END, ',' ORDER BY CASE WHEN kind = 'r' THEN lpad(CAST(job AS VARCHAR), 9, '0') END), '') AS consumers
FROM (SELECT tbl, job, 'w' AS kind FROM fx_writes UNION ALL SELECT tbl, job, 'r' FROM fx_reads) GROUP BY tbl
""")
def g07(fx):
    """Producers and consumers of each table."""
    both = fx["fx_writes"].withColumn("kind", F.lit("w")).unionByName(fx["fx_reads"].withColumn("kind", F.lit("r")))
    name = F.lpad(F.col("job").cast("string"), 9, "0")
    return both.groupBy("tbl").agg(*[joined(F.collect_set(F.when(F.col("kind") == k, name))).alias(n) for k, n in (("w", "producers"), ("r", "consumers"))])


_CLOSURE = """
WITH RECURSIVE c(start, node) AS (
  SELECT s.job, e.{to} FROM (SELECT DISTINCT job FROM fx_jobs) s JOIN fx_edges e ON e.{frm} = s.job
  UNION SELECT c.start, e.{to} FROM c JOIN fx_edges e ON e.{frm} = c.node)
SELECT '{way}' AS way, start, node FROM c
"""


@query("g08_closure", _CLOSURE.format(frm="job", to="dependent_job", way="up"))
def g08(fx):
    """All jobs that a job needs, directly or not."""
    found = graph.closure(fx["fx_edges"], fx["fx_jobs"])
    return found.select(F.lit("up").alias("way"), "start", "node")


@query("g08_closure_down", _CLOSURE.format(frm="dependent_job", to="job", way="down"))
def g08_down(fx):
    """All jobs that need a job."""
    found = graph.closure(graph.reversed_edges(fx["fx_edges"]), fx["fx_jobs"])
    return found.select(F.lit("down").alias("way"), "start", "node")


@query("g09_topological_levels", """
WITH RECURSIVE p(node, level) AS (
  SELECT node, 0 FROM (SELECT job AS node FROM fx_edges UNION SELECT dependent_job FROM fx_edges)
  UNION SELECT e.dependent_job, p.level + 1 FROM p JOIN fx_edges e ON e.job = p.node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM p GROUP BY node
""")
def g09(fx):
    """Longest distance of each job from the jobs that nothing needs."""
    return graph.topological_levels(fx["fx_edges"])


_RANK = "CASE category WHEN 'REF' THEN 0 WHEN 'STG' THEN 1 WHEN 'DIM' THEN 2 WHEN 'FCT' THEN 3 WHEN 'MV' THEN 4 WHEN 'RPT' THEN 5 ELSE 6 END"


@query("g09_topological_order", _NODE_CTE + f""",
se AS (SELECT a.rpt, e.dependent_job AS source, e.job AS target FROM fx_edges e JOIN nodes a ON a.node = e.dependent_job JOIN nodes b ON b.rpt = a.rpt AND b.node = e.job),
lv(rpt, node, level) AS (SELECT rpt, node, 0 FROM nodes UNION SELECT lv.rpt, se.target, lv.level + 1 FROM lv JOIN se ON se.rpt = lv.rpt AND se.source = lv.node),
m AS (SELECT rpt, node, max(level) AS level FROM lv GROUP BY rpt, node)
SELECT m.rpt, m.node, row_number() OVER (PARTITION BY m.rpt ORDER BY level, depth DESC, {_RANK}, m.node) AS step FROM m JOIN nodes n ON n.rpt = m.rpt AND n.node = m.node JOIN fx_jobs j ON j.job = m.node
""")
def g09_order(fx):
    """Execution order of each report: producers first, the deepest of a level before others."""
    nodes = report_nodes(fx)
    rank = F.when(F.col("category") == "REF", 0).when(F.col("category") == "STG", 1).when(F.col("category") == "DIM", 2).when(F.col("category") == "FCT", 3).when(F.col("category") == "MV", 4).when(F.col("category") == "RPT", 5).otherwise(6)
    ranked = nodes.join(fx["fx_jobs"].select(F.col("job").alias("node"), rank.alias("rank")).hint("merge"), "node")
    return graph.execution_order(ranked, scoped_edges(fx["fx_edges"], nodes))


@query("g10_critical_path", """
WITH RECURSIVE p(root, node, total) AS (
  SELECT root_job, root_job, runtime_sec FROM fx_roots JOIN fx_jobs ON job = root_job
  UNION SELECT p.root, e.dependent_job, p.total + j.runtime_sec FROM p JOIN fx_edges e ON e.job = p.node JOIN fx_jobs j ON j.job = e.dependent_job),
b AS (SELECT root, node, max(total) AS total FROM p GROUP BY root, node),
t AS (SELECT b.root, b.node, b.total, min(CASE WHEN a.total + j.runtime_sec = b.total THEN a.node END) AS parent
      FROM b JOIN fx_jobs j ON j.job = b.node LEFT JOIN fx_edges e ON e.dependent_job = b.node LEFT JOIN b a ON a.root = b.root AND a.node = e.job AND b.node <> b.root GROUP BY b.root, b.node, b.total),
w(root, node, total, up) AS (
  SELECT root, node, total, 0 FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY total DESC, node) AS r FROM t) WHERE r = 1
  UNION ALL SELECT w.root, u.node, u.total, w.up + 1 FROM w JOIN t ON t.root = w.root AND t.node = w.node JOIN t u ON u.root = t.root AND u.node = t.parent)
SELECT root, CAST(max(up) OVER (PARTITION BY root) - up AS INTEGER) AS step, node, round(total, 2) AS total FROM w
""")
def g10(fx):
    """The chain with the largest total runtime of each report."""
    return graph.critical_path(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"]).withColumn("total", F.round("total", 2))


@query("g11_same_depth_pairs", _NODE_CTE + " SELECT a.rpt, e.dependent_job AS source, e.job AS target, a.depth FROM fx_edges e JOIN nodes a ON a.node = e.dependent_job JOIN nodes b ON b.rpt = a.rpt AND b.node = e.job WHERE a.depth = b.depth")
def g11(fx):
    """Dependencies between jobs of one depth."""
    nodes = report_nodes(fx)
    edges = scoped_edges(fx["fx_edges"], nodes)
    one = nodes.toDF("rpt", "source", "depth")
    two = nodes.toDF("rpt", "target", "other")
    return edges.join(one, ["rpt", "source"]).join(two, ["rpt", "target"]).where("depth = other").select("rpt", "source", "target", "depth")


@query("g12_table_graph", """
SELECT r.tbl AS source_table, w.tbl AS target_table, count(DISTINCT w.job) AS n_jobs, min(w.job) AS first_job
FROM fx_reads r JOIN fx_writes w ON r.job = w.job WHERE r.tbl <> w.tbl GROUP BY r.tbl, w.tbl
""")
def g12(fx):
    """Edges between tables: a job reads the one and writes the other."""
    reads, writes = fx["fx_reads"].toDF("job", "source_table"), fx["fx_writes"].toDF("job", "target_table")
    return reads.join(writes, "job").where("source_table <> target_table").groupBy("source_table", "target_table").agg(F.count_distinct("job").alias("n_jobs"), F.min("job").alias("first_job"))


@query("g13_statistics", """
SELECT category, count(*) AS n_jobs, count(DISTINCT sql_object) AS n_objects, count(*) FILTER (WHERE e.job IS NOT NULL) AS n_linked,
       round(sum(runtime_sec), 2) AS total_sec, round(avg(runtime_sec), 2) AS mean_sec, max(runtime_sec) AS longest_sec
FROM fx_jobs n LEFT JOIN (SELECT job FROM fx_edges UNION SELECT dependent_job FROM fx_edges) e ON e.job = n.job GROUP BY category
""")
def g13(fx):
    """Counts and runtimes by kind of job, and how many have an edge."""
    linked = fx["fx_edges"].select("job").union(fx["fx_edges"].select("dependent_job")).distinct().withColumn("linked", F.lit(1))
    return fx["fx_jobs"].join(linked, "job", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("sql_object").alias("n_objects"), F.count("linked").alias("n_linked"),
        F.round(F.sum("runtime_sec"), 2).alias("total_sec"), F.round(F.avg("runtime_sec"), 2).alias("mean_sec"), F.max("runtime_sec").alias("longest_sec"),
    )


@query("g14_runbook", _NODE_CTE + " SELECT rpt, CAST(dense_rank() OVER (PARTITION BY rpt ORDER BY depth DESC) AS BIGINT) AS grp, CAST(row_number() OVER (PARTITION BY rpt ORDER BY depth DESC, node) AS BIGINT) AS step, node FROM nodes")
def g14(fx):
    """Numbered steps of each report, from the deepest group up."""
    from pyspark.sql import Window

    w = Window.partitionBy("rpt").orderBy(F.desc("depth"))
    return report_nodes(fx).select("rpt", F.dense_rank().over(w).cast("long").alias("grp"), F.row_number().over(w.orderBy(F.desc("depth"), "node")).cast("long").alias("step"), "node")


@query("g15_column_hops", """
SELECT object, src_table, src_col, tgt_table FROM (
  SELECT *, row_number() OVER (PARTITION BY object, src_table, src_col, tgt_table ORDER BY pos) AS r FROM fx_lineage WHERE src_col = 'K3' AND tgt_table <> src_table) WHERE r = 1
""")
def g15(fx):
    """Distinct hops of one source column."""
    hops = fx["fx_lineage"].where("src_col = 'K3' and tgt_table <> src_table")
    return hops.groupBy("object", "src_table", "src_col", "tgt_table").agg(F.min("pos").alias("pos")).drop("pos")


@query("g16_column_search", "SELECT DISTINCT concat(src_table, '.', src_col) AS col FROM fx_lineage WHERE contains(concat(src_table, '.', src_col), '1.K') ORDER BY col LIMIT 30")
def g16(fx):
    """The first 30 columns that hold a search text."""
    name = F.concat_ws(".", "src_table", "src_col")
    return fx["fx_lineage"].select(name.alias("col")).where(F.col("col").contains("1.K")).distinct().orderBy("col").limit(30)


@query("g17_node_filter", "SELECT job, is_pass OR is_stop AS framework, category IN ('MV', 'RPT') AS presented FROM fx_jobs WHERE NOT (is_pass AND category = 'REF') AND runtime_sec > 905")
def g17(fx):
    """Predicates of nodes and a filter of three states."""
    kept = ~(F.col("is_pass") & (F.col("category") == "REF")) & (F.col("runtime_sec") > 905)
    return fx["fx_jobs"].where(kept).select("job", (F.col("is_pass") | F.col("is_stop")).alias("framework"), F.col("category").isin("MV", "RPT").alias("presented"))


@query("g18_before_after", """
SELECT coalesce(a.job, b.job) AS job, coalesce(a.dependent_job, b.dependent_job) AS dependent_job,
       CASE WHEN b.job IS NULL THEN 'removed' WHEN a.job IS NULL THEN 'added' ELSE 'same' END AS status
FROM fx_edges a FULL JOIN (SELECT job, dependent_job FROM fx_edges WHERE job % 10 <> 0 AND dependent_job % 10 <> 0 UNION SELECT 1 AS job, dependent_job FROM fx_edges WHERE job % 100 = 50) b
ON a.job = b.job AND a.dependent_job = b.dependent_job
""")
def g18(fx):
    """Edges before and after a removal, with their status."""
    e = fx["fx_edges"]
    after = e.where("job % 10 <> 0 and dependent_job % 10 <> 0").union(e.where("job % 100 = 50").select(F.lit(1).cast("long"), "dependent_job")).distinct().toDF("job_b", "dep_b")
    both = e.join(after, (e["job"] == after["job_b"]) & (e["dependent_job"] == after["dep_b"]), "full")
    status = F.when(F.col("job_b").isNull(), "removed").when(F.col("job").isNull(), "added").otherwise("same")
    return both.select(F.coalesce("job", "job_b").alias("job"), F.coalesce("dependent_job", "dep_b").alias("dependent_job"), status.alias("status"))


@query("g19_dictionary_codes", "SELECT src_table, CAST(dense_rank() OVER (ORDER BY src_table) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT src_table FROM fx_lineage)")
def g19(fx):
    """Numbers for the distinct tables, in order."""
    names = fx["fx_lineage"].select("src_table").distinct().withColumn("all", F.lit(0))
    return numbered(names, "all", [F.asc("src_table")], "code").select("src_table", (F.col("code") - 1).alias("code"))


@query("g20_cycles", """
WITH RECURSIVE c(a, b) AS (SELECT job, dependent_job FROM fx_cyclic UNION SELECT c.a, e.dependent_job FROM c JOIN fx_cyclic e ON e.job = c.b)
SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a
""")
def g20(fx):
    """Jobs on cycles, by strong component."""
    return graph.strong_components(fx["fx_cyclic"])


@query("g21_bounded_reach", """
WITH RECURSIVE c(start, node, hops) AS (
  SELECT e.job, e.dependent_job, 1 FROM fx_edges e
  UNION SELECT c.start, e.dependent_job, c.hops + 1 FROM c JOIN fx_edges e ON e.job = c.node WHERE c.hops < 4)
SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM c GROUP BY start, node
""")
def g21(fx):
    """What a job reaches in four steps or fewer."""
    return graph.closure(fx["fx_edges"], fx["fx_jobs"], most_rounds=4)
