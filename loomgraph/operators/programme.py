"""Scoring, de-duplication, simulation and roll-ups of findings.

``recs`` has (pos, category, rpt, target_table, jobs array<long>, hops, risk, est_min). Sorts are only taken inside report or
phase partitions, or over relations that are one row per category, report or phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import ladder, risk_rank

from .graph import closure

#: Points of a category by the first text that it contains, else 10 (fixed values of the scoring rule).
CATEGORY_POINTS = (
    ("D. Serial Orchestration Chain", 25), ("C. OFFSET", 22), ("C. Near-Duplicate", 22), ("A. Redundant Multi-Source", 18), ("B. Pass-Through", 16), ("G. Duplicate Column-Lineage", 14),
    ("H. Stale Intermediate", 12), ("I. Cyclic Refresh", 12), ("E. MV Elimination", 10), ("J. Over-Fanout MV", 10), ("K. Repeated Transformations", 16), ("L. Overlapping Preprocessing", 15),
    ("M. Orchestration Edge Without Data Handoff", 14), ("N. Post-Consumption Update Pattern", 14), ("F. LLM-Identified Issues", 8),
)
#: Execution policy by category prefix: local ones first, then what is deferred.
LOCAL_PREFIXES, DEFER_WORDS = ("B.", "D.", "F."), ("Duplicate",)


def merged_findings(recs: DataFrame) -> DataFrame:
    """One row per (family, jobs, target): its first row, the largest savings and risk, and how many were merged."""
    key = [F.substring("category", 1, 2).alias("family"), F.array_join(F.transform(F.array_sort("jobs"), lambda j: j.cast("string")), ",").alias("job_key"), F.col("target_table")]
    top = F.max(risk_rank(F.col("risk")))
    return recs.groupBy("rpt", *key).agg(
        F.min("pos").alias("pos"), F.min_by("category", "pos").alias("category"), F.max("hops").alias("hops"), F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), top.cast("int") + 1).alias("risk"), F.max("est_min").alias("est_min"), F.count(F.lit(1)).alias("n_merged")
    )


def runtime_estimate(category: Column, runtimes: Column, hops: Column) -> Column:
    """Minutes that a finding saves: chains keep their longest job, single steps the shortest, others the ``hops`` shortest."""
    total = F.aggregate(runtimes, F.lit(0.0), lambda a, x: a + x)
    shortest = F.slice(F.array_sort(runtimes), 1, F.greatest(F.least(hops, F.size(runtimes)), F.lit(0)).cast("int"))
    return F.bround(
        F.when(category.startswith("F."), 0.0)
        .when(category.startswith("D."), total - F.array_max(runtimes))
        .when(category.startswith("M."), F.array_min(runtimes))
        .otherwise(F.aggregate(shortest, F.lit(0.0), lambda a, x: a + x)),
        2,
    )


def policy(category: Column) -> Column:
    local = F.lit(False)
    for p in LOCAL_PREFIXES:
        local = local | category.startswith(p)
    defer = F.lit(False)
    for w in DEFER_WORDS:
        defer = defer | category.contains(w)
    return ladder([(local, "EXECUTE_LOCALLY"), (defer, "DEFER_OR_KEEP")], "EXECUTE_GLOBAL_PROGRAM")


def score(recs: DataFrame) -> DataFrame:
    """Points of each finding, at least 0.

    ``recs`` also has depth_share (its deepest job's depth over the graph's, 0 to 1, or null), n_signals and unmapped (of
    suggested findings), n_merged, global_min (minutes saved over all reports) and n_rpts.
    """
    category = F.lit(10)
    for text, points in reversed(CATEGORY_POINTS):
        category = F.when(F.col("category").contains(text), points).otherwise(category)
    risk = F.when(F.col("risk") == "LOW", 25).when(F.col("risk") == "HIGH", 5).otherwise(15)
    suggested = F.when(F.col("category").startswith("F."), F.least(F.floor(F.col("n_signals") / 5), F.lit(8)) - F.when(F.col("unmapped"), 5).otherwise(0)).otherwise(0)
    merged = F.when(F.col("n_merged") > 1, 10).otherwise(0)
    beyond = F.least(F.floor(F.greatest(F.col("global_min") - F.col("est_min"), F.lit(0)) / 5), F.lit(15)) + F.least(F.greatest(F.col("n_rpts") - 1, F.lit(0)) * 2, F.lit(10))
    bonus = F.when(policy(F.col("category")) == "EXECUTE_GLOBAL_PROGRAM", 6).when(policy(F.col("category")) == "DEFER_OR_KEEP", -4).otherwise(0)
    points = category + F.least(12 * F.col("hops"), F.lit(40)) + risk + F.coalesce(F.floor(15 * F.col("depth_share")), F.lit(0)) + F.least(F.size("jobs"), F.lit(8)) + suggested + merged
    points = points + F.least(F.floor(F.col("est_min") / 5), F.lit(20)) + beyond + bonus
    return recs.withColumn("score", F.greatest(points, F.lit(0)).cast("bigint"))


def credited_once(recs: DataFrame) -> DataFrame:
    """Of findings with one target and job list, only the first (by phase order, then pos) keeps its savings."""
    w = Window.partitionBy("target_table", "job_key").orderBy(F.desc(F.col("hops") > 0), "pos")
    return recs.withColumn("credited", F.when(F.row_number().over(w) == 1, F.col("hops")).otherwise(F.lit(0)).cast("bigint"))


def what_if(recs: DataFrame, edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Remove the jobs behind the first of each finding with savings, never a root; what the roots still reach, and how deep it was.

    ``depth`` has (root, node, depth).
    """
    roots = depth.where("depth = 0").select(F.col("node").alias("job")).distinct()
    gone = recs.where((F.col("hops") > 0) & (F.size("jobs") > 1)).select(F.explode(F.expr("slice(jobs, 2, size(jobs))")).alias("job")).distinct().join(roots, "job", "left_anti")
    left = edges.join(gone, "job", "left_anti").join(gone.toDF("dependent_job"), "dependent_job", "left_anti").select("job", "dependent_job")
    reached = closure(left, roots).select(F.col("start").alias("root"), "node").unionByName(roots.select(F.col("job").alias("root"), F.col("job").alias("node"))).distinct()
    before = depth.groupBy("root").agg(F.count(F.lit(1)).alias("n_before"), F.max("depth").alias("depth_before"))
    after = reached.join(depth, ["root", "node"]).groupBy("root").agg(F.count(F.lit(1)).alias("n_after"), F.max("depth").alias("depth_after"))
    return before.join(after, "root")


def phase_of(recs: DataFrame, phases: DataFrame) -> DataFrame:
    """The phase of the first entry whose prefix the category begins with; 5 where none does. ``phases`` is a short list."""
    hits = recs.join(F.broadcast(phases), F.col("category").startswith(F.col("prefix")), "left")  # a configured list of a few rows
    found = hits.groupBy(*recs.columns).agg(F.min_by("phase", "at").alias("phase"))
    return found.withColumn("phase", F.coalesce("phase", F.lit(5)))


def cumulative(recs: DataFrame, by: str, value: str) -> DataFrame:
    """Sums by group and their running total; the window is over one row per group."""
    sums = recs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.withColumn("running", F.sum("total").over(Window.partitionBy(F.lit(1)).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))


def complexity_rank(recs: DataFrame) -> DataFrame:
    """Reports by complexity, and how many (target, jobs) findings each brings that no report of a lower rank has."""
    sums = recs.groupBy("rpt").agg(F.count_distinct("target_table", "job_key").alias("n_recs"), F.count_distinct("target_table").alias("n_targets"), F.count_if(F.col("risk") == "HIGH").alias("n_high"))
    points = F.round(1.5 * F.col("n_recs") + 2 * F.col("n_targets") + 5 * F.col("n_high"), 1)
    order = sums.withColumn("points", points).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("points", "rpt")).cast("bigint"))
    first = recs.join(order.select("rpt", "rank"), "rpt").groupBy("target_table", "job_key").agg(F.min("rank").alias("rank"))
    fresh = first.groupBy("rank").agg(F.count(F.lit(1)).alias("net_new"))
    running = F.sum("net_new").over(Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    tier = F.when(F.col("rank") <= 2, "EASY").when(F.col("rank") <= 4, "MEDIUM").otherwise("HARD")
    return order.join(fresh, "rank", "left").withColumn("net_new", F.coalesce("net_new", F.lit(0))).select("rpt", "rank", "points", "n_recs", "net_new", running.alias("running"), tier.alias("tier"))


def registry(recs: DataFrame, packages: DataFrame, ranks: DataFrame) -> DataFrame:
    """(package, rpt, rank, tier, scope, agents, n_recs, mode): a row for each package, with or without findings.

    ``recs`` has (pos, master_id, rpts, agent, packages), both lists arrays; ``packages`` (package) lists all, ``ranks``
    (rpt, rank) the reports from 0. A package belongs to the first report of its first finding's best-ranked one; a
    finding counts once by its master id, whatever procedures of a package it names. Packages without findings stand alone.
    """
    each = recs.select("pos", "master_id", "agent", F.size("rpts").alias("n_rpts"), "rpts", F.explode(F.when(F.size("packages") > 0, F.col("packages")).otherwise(F.array(F.lit("[NO PACKAGE]")))).alias("package"))
    best = each.select("pos", F.explode("rpts").alias("rpt")).distinct().join(ranks, "rpt").groupBy("pos").agg(F.min(F.struct("rank", "rpt")).alias("primary"))
    each = each.join(best, "pos", "left")
    first = F.min_by(F.struct("primary", "n_rpts"), "pos")
    by = each.groupBy("package").agg(first.alias("f"), F.collect_set("agent").alias("agents"), F.count_distinct("master_id").alias("n_recs"))
    rank = F.coalesce("f.primary.rank", F.lit(999))
    found = by.select(
        "package", F.coalesce("f.primary.rpt", F.lit("UNKNOWN")).alias("rpt"), (rank + 1).cast("int").alias("rank"), F.when(rank < 3, 1).when(rank < 7, 2).otherwise(3).alias("tier"),
        F.when(F.col("f.n_rpts") > 1, "GLOBAL").otherwise("LOCAL").alias("scope"), F.array_join(F.array_sort(F.array_union("agents", F.array(F.lit("standardizer")))), ",").alias("agents"), "n_recs",
        F.when(F.array_contains("agents", "standardizer"), "rec-driven").otherwise("auto-final-pass").alias("mode"),
    )
    alone = packages.select("package").distinct().join(found.select(F.upper("package").alias("up")), F.upper("package") == F.col("up"), "left_anti")
    alone = alone.select("package", F.lit("STANDALONE").alias("rpt"), F.lit(999).alias("rank"), F.lit(4).alias("tier"), F.lit("STANDALONE").alias("scope"), F.lit("optimizer,standardizer").alias("agents"), F.lit(0).cast("long").alias("n_recs"), F.lit("free-scan").alias("mode"))
    return found.unionByName(alone)
