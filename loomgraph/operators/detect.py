"""Detectors: relations in, findings out. All reports go through one plan, with ``rpt`` among the keys where there are several.

``writes`` and ``reads`` are (job, tbl), ``edges`` (job, dependent_job), ``jobs`` (job, category, ...), ``lineage`` column
lineage with (pos, job, tgt_table, tgt_col, src_table, src_col).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import any_of, joined
from loomgraph.functions.numbering import numbered
from loomgraph.functions.scratch import materialize

from .clusters import greedy_clusters, similar_pairs
from .graph import closure

def name() -> Column:
    """Job numbers as texts that sort like numbers."""
    return F.lpad(F.col("job").cast("string"), 9, "0")


def multi_source_loads(writes: DataFrame) -> DataFrame:
    """Targets that two jobs or more write; all loads but one could go."""
    by = writes.groupBy("tbl").agg(F.count_distinct("job").alias("n_jobs"), joined(F.collect_set(name())).alias("jobs"))
    return by.where("n_jobs >= 2").withColumn("savings", F.col("n_jobs") - 1)


def updates_in_place(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Jobs that read and write one table."""
    return writes.join(reads, ["job", "tbl"], "left_semi").distinct()


def pass_through_tables(writes: DataFrame, reads: DataFrame, lineage: DataFrame, least_columns: int = 5) -> DataFrame:
    """Tables with one producer and one consumer from which many columns flow on."""
    one = lambda df, kind: df.groupBy("tbl").agg(F.count_distinct("job").alias("n"), F.min("job").alias(kind)).where("n = 1").drop("n")
    wide = lineage.groupBy(F.col("src_table").alias("tbl")).agg(F.count_distinct("tgt_table", "tgt_col").alias("n_columns")).where(F.col("n_columns") >= least_columns)
    return one(writes, "producer").join(one(reads, "consumer"), "tbl").where("producer <> consumer").join(wide, "tbl")


def similar_sets(lineage: DataFrame, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Column sets of each target (tgt_table, columns, job), and the similar ones among the distinct sets (columns_a, columns_b, shared).

    Jobs with equal sets are one class, so the comparison grows with the distinct sets, not with the jobs; sets are joined by
    a shared column and compared both ways, each with itself too.
    """
    members = lineage.groupBy("tgt_table", "job").agg(F.array_sort(F.collect_set("tgt_col")).alias("columns"))
    classes = members.select("tgt_table", "columns").distinct()
    one = classes.select("tgt_table", F.col("columns").alias("columns_a"), F.explode("columns").alias("column"))
    two = classes.select("tgt_table", F.col("columns").alias("columns_b"), F.explode("columns").alias("column"))
    shared = one.join(two, ["tgt_table", "column"]).groupBy("tgt_table", "columns_a", "columns_b").agg(F.count(F.lit(1)).alias("shared"))
    alike = den * F.col("shared") >= num * (F.size("columns_a") + F.size("columns_b") - F.col("shared"))
    return members, shared.where(alike)


#: Jobs of a block of ``similar_jobs``.
BLOCK = 4096


def similar_jobs(lineage: DataFrame, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """Pairs of jobs whose sets of columns of one target have a Jaccard similarity of num/den or more.

    The result has every pair, so it grows with the square of the jobs of a target; where groups are large, use
    ``similar_sets``. Jobs with equal sets are cut into blocks of about ``block``, one row each. What is shuffled are pairs of
    blocks, dealt by both of them; they are taken apart behind the last shuffle, so no task gathers the pairs of a set and
    none of them is shuffled.
    """
    members, pairs = similar_sets(lineage, num, den)
    members, pairs = materialize(members, "members"), materialize(pairs, "similar-sets")
    sizes = members.groupBy("tgt_table", "columns").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
    dealt = members.join(sizes, ["tgt_table", "columns"]).withColumn("block", F.pmod(F.xxhash64("job"), F.col("n_blocks")))
    blocks = materialize(dealt.groupBy("tgt_table", "columns", "block").agg(F.collect_list("job").alias("jobs")), "job-blocks")
    of = lambda k: blocks.select("tgt_table", *[F.col(c).alias(f"{c}_{k}") for c in ("columns", "block", "jobs")])
    met = pairs.join(of("a").drop("jobs_a"), ["tgt_table", "columns_a"]).join(of("b").drop("jobs_b"), ["tgt_table", "columns_b"])
    for k in "ab":
        met = met.join(of(k).hint("merge"), ["tgt_table", f"columns_{k}", f"block_{k}"])
    keys = ["tgt_table", "columns_a", "block_a", "columns_b", "block_b"]
    each = met.repartition(*keys).select("tgt_table", "shared", "jobs_b", F.explode("jobs_a").alias("job_a"))
    return each.select("tgt_table", "shared", "job_a", F.explode("jobs_b").alias("job_b")).where("job_a < job_b").select("tgt_table", "job_a", "job_b", "shared")


def similar_clusters(lineage: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """(tgt_table, cluster, job): jobs join the first cluster all of whose members are similar, in the order of their first rows.

    Jobs with equal column sets always share a cluster, as what is similar to the one is to the other. The distinct sets of a
    target are numbered by their first rows and clustered in rounds (``greedy_clusters``); jobs are joined to the clusters of
    their sets. Clusters are numbered from 0 in the order in which they were founded; those of one job are left out.
    """
    sets = lineage.groupBy("tgt_table", "job").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("tgt_col")).alias("columns"))
    classes = sets.groupBy("tgt_table", "columns").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    classes = numbered(classes, "tgt_table", [F.col("pos"), F.col("columns")], "item").withColumnRenamed("tgt_table", "grp")
    classes = materialize(classes.select("grp", "item", "columns", "n"), "column-sets")
    found = greedy_clusters(classes.select("grp", "item"), similar_pairs(classes.select("grp", "item", F.col("columns").alias("members")), num, den))
    found = materialize(found, "clusters")
    founders = numbered(found.where("item = founder").select("grp", "founder"), "grp", [F.col("founder")], "nth")
    of_sets = classes.join(found, ["grp", "item"])
    several = of_sets.groupBy("grp", "founder").agg(F.sum("n").alias("size")).where("size > 1").join(founders, ["grp", "founder"])
    of_sets = of_sets.join(several, ["grp", "founder"]).select(F.col("grp").alias("tgt_table"), "columns", (F.col("nth") - 1).cast("int").alias("cluster"))
    return sets.join(of_sets, ["tgt_table", "columns"]).select("tgt_table", "cluster", "job")


def serial_chains(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """(first, job, step): chains of jobs of the kind "OTHER" that have one dependency and one dependent each.

    Chains are found by pointer jumping: each job doubles its distance to the head of its chain in a round.
    """
    plain = jobs.where("category = 'OTHER'").select("job")
    inner = edges.join(plain, "job", "left_semi").join(plain.toDF("dependent_job"), "dependent_job", "left_semi")
    single_out = edges.groupBy("job").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("job")
    single_in = edges.groupBy("dependent_job").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("dependent_job")
    links = inner.join(single_out, "job", "left_semi").join(single_in, "dependent_job", "left_semi").select("job", F.col("dependent_job").alias("next"))
    links = materialize(links, "chain-links")
    heads = links.select("job").union(links.select("next")).distinct()
    at = heads.join(links.select(F.col("next").alias("job"), F.col("job").alias("up")), "job", "left").select("job", F.coalesce("up", "job").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("step"))
    at = materialize(at, "chains")
    for _ in range(64):
        up = at.select(F.col("job").alias("up"), F.col("up").alias("top"), F.col("step").alias("more"))
        after = materialize(at.join(up, "up").select("job", F.col("top").alias("up"), (F.col("step") + F.col("more")).alias("step"), (F.col("top") != F.col("up")).alias("moved")), "chains")
        at = after.select("job", "up", "step")
        if after.where("moved").isEmpty():
            break
    return at.select(F.col("up").alias("first"), "job", F.col("step").cast("int").alias("step"))


def view_consumers(edges: DataFrame, jobs: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Materialised views with their dependents that read what they write: one is a candidate to go, several share it."""
    views = jobs.where("category = 'MV'").select("job", "runtime_sec")
    own = writes.join(views, "job", "left_semi").withColumnRenamed("job", "mv")
    used = own.join(reads, "tbl").where("mv <> job").select("mv", "job").distinct()
    by = used.groupBy("mv").agg(F.count(F.lit(1)).alias("n_consumers"), joined(F.collect_set(name())).alias("consumers"))
    kind = F.when(F.col("n_consumers") > 1, "SHARED").otherwise("ELIMINATE")
    risk = F.when(F.col("n_consumers") >= 4, "HIGH").otherwise("MEDIUM")
    return by.withColumn("kind", kind).withColumn("risk", risk).withColumn("blast", F.least(F.col("n_consumers"), F.lit(10)))


def unread_tables(writes: DataFrame, reads: DataFrame) -> DataFrame:
    return writes.join(reads.select("tbl").distinct(), "tbl", "left_anti")


def duplicated_flows(lineage: DataFrame) -> DataFrame:
    """Column flows that several jobs produce, counted by table pair."""
    flows = lineage.where("src_col <> ''").groupBy("src_table", "src_col", "tgt_table", "tgt_col").agg(F.count_distinct("job").alias("n")).where("n > 1")
    return flows.groupBy("src_table", "tgt_table").agg(F.count(F.lit(1)).alias("n_flows"), F.max("n").alias("most_jobs"))


def identical_mappings(lineage: DataFrame, least_pairs: int = 3) -> DataFrame:
    """Groups of jobs with the same set of column pairs between two tables."""
    pairs = lineage.where("src_col <> ''").groupBy("src_table", "tgt_table", "job").agg(joined(F.collect_set(F.concat_ws(">", "src_col", "tgt_col"))).alias("mapping"), F.count_distinct("src_col", "tgt_col").alias("n_pairs"))
    same = pairs.where(F.col("n_pairs") >= least_pairs).groupBy("src_table", "tgt_table", "mapping").agg(F.count(F.lit(1)).alias("n_jobs"), joined(F.collect_set(name())).alias("jobs"))
    return same.where("n_jobs >= 2")


def unneeded_edges(edges: DataFrame, jobs: DataFrame, reads: DataFrame, writes: DataFrame, most_hops: int = 4) -> DataFrame:
    """Edges between materialised views without a hand-over of data, directly or over a few tables."""
    views = jobs.where("category = 'MV'").select("job")
    between = edges.join(views, "job", "left_semi").join(views.toDF("dependent_job"), "dependent_job", "left_semi")
    between = between.join(reads.select("job").distinct(), "job", "left_semi")  # a job that reads nothing shows nothing
    flow = reads.toDF("job", "source").join(writes.toDF("job", "target"), "job").where("source <> target").select(F.col("source").alias("job"), F.col("target").alias("dependent_job")).distinct()
    starts = writes.join(between.select(F.col("dependent_job").alias("job")), "job", "left_semi").select(F.col("tbl").alias("job")).distinct()
    far = closure(flow, starts, most_hops).select(F.col("start").alias("tbl"), F.col("node").alias("reached"))
    handed = writes.select(F.col("job").alias("dependent_job"), "tbl").join(far.unionByName(starts.select(F.col("job").alias("tbl"), F.col("job").alias("reached"))), "tbl")
    met = handed.join(reads.toDF("job", "reached"), "reached").select("job", "dependent_job").distinct()
    return between.join(met, ["job", "dependent_job"], "left_anti")


def update_order_risks(reads: DataFrame, writes: DataFrame, edges: DataFrame) -> DataFrame:
    """A table's readers beside the jobs that update it in place, and which of the two an edge puts first."""
    updaters = updates_in_place(reads, writes).withColumnRenamed("job", "updater")
    readers = reads.withColumnRenamed("job", "reader")
    pairs = updaters.join(readers, "tbl").where("updater <> reader")
    first = edges.select(F.col("job").alias("reader"), F.col("dependent_job").alias("updater"), F.lit(True).alias("updater_first")).distinct()
    second = edges.select(F.col("job").alias("updater"), F.col("dependent_job").alias("reader"), F.lit(True).alias("reader_first")).distinct()
    marked = pairs.join(first, ["reader", "updater"], "left").join(second, ["reader", "updater"], "left")
    order = F.when(F.col("updater_first"), "UPDATER_FIRST").when(F.col("reader_first"), "READER_FIRST").otherwise("NONE")
    return marked.select("tbl", "updater", "reader", order.alias("ordering"))


def feedback_loops(reads: DataFrame, writes: DataFrame, most_hops: int = 8) -> DataFrame:
    """Jobs that read a table which is some hops downstream of one that they write."""
    flow = reads.toDF("job", "source").join(writes.toDF("job", "target"), "job").where("source <> target").select(F.col("source").alias("job"), F.col("target").alias("dependent_job")).distinct()
    starts = writes.join(reads.select("job").distinct(), "job", "left_semi").select(F.col("tbl").alias("job")).distinct()
    far = closure(flow, starts, most_hops)
    return writes.join(far.toDF("tbl", "reached", "hops"), "tbl").join(reads.toDF("job", "reached"), ["job", "reached"]).groupBy("job", "tbl", "reached").agg(F.min("hops").alias("hops"))


# Fixed values of the naming rules: intermediate tables, hybrid names, and log or control tables, which are left alone.
INTERMEDIATE_SUFFIXES = ("_TMP", "_TABLE_TMP", "_DEBUG_TRC", "_TRC", "_UPD_PAYEE_NAME", "_BKP_PREV_MONTH", "_BKP")
INTERMEDIATE_PARTS = ("_INTERMEDIATE_MV_TBL", "_INTERMEDIATE_MV_TBL2", "_INTERMEDIATE_")
HYBRID_PREFIX, STAGING_PREFIX = "FCT_RPT_", "STG_"
LOG_PARTS = ("_DEBUG_TRC", "_TRC", "EXEC_STATUS_LOG", "PROC_EXEC_STATUS", "_JOB_LOG", "PRCS_JOB_LOG", "JOB_LOG_MESSAGE", "_AUDIT_LOG", "AUDIT_LOG", "LOG_TABLE", "PRCS_GRP_TBL_LOAD_DEBUG", "MILESTONE_TABLE", "_MILESTONE_")
LOG_PREFIXES = ("PRCS_JOB_LOG_", "PRCS_GRP_TBL_", "SSL_PACKAGE_")


def is_log_table(table: Column) -> Column:
    """Log, trace and control tables, and short names that are aliases."""
    t = F.upper(F.trim(table))
    return any_of([t.contains(x) for x in LOG_PARTS] + [t.startswith(x) for x in LOG_PREFIXES] + [t.rlike(r"^(TAB\d*|T\d+|[A-Z]\d*|[A-Z]{1,3})$")])


def intermediate_names(writes: DataFrame, reads: DataFrame, reports: DataFrame) -> DataFrame:
    """(rpt, tbl, kind, suggestion, n_writers, n_readers, n_rpts, blast, decision): written tables whose names break the rules.

    ``writes`` and ``reads`` are (job, tbl), ``reports`` (rpt, job). Writers and readers are counted in the report, its
    tables need a writer there; the reports and jobs that a change touches are counted over all.
    """
    # Names are written before they are tested, and so are the odd ones: else each of the tests takes in the whole expression
    # that a name comes from, on all sides of all joins, and the plan alone fills the driver.
    names = materialize(writes.select("tbl").union(reads.select("tbl")).distinct(), "table-names").withColumn("up", F.upper("tbl"))
    inside = any_of([F.col("up").endswith(x) for x in INTERMEDIATE_SUFFIXES] + [F.col("up").contains(x) for x in INTERMEDIATE_PARTS])
    hybrid = F.col("up").startswith(HYBRID_PREFIX)
    odd = names.where((inside | hybrid) & ~F.col("up").endswith("_EXG") & ~is_log_table(F.col("up")) & ~F.col("up").contains(",")).select("tbl", F.when(inside, "INTERMEDIATE").otherwise("HYBRID").alias("kind"))
    odd = materialize(odd, "odd-names")
    used = writes.select("job", "tbl", F.lit(1).alias("w")).unionByName(reads.select("job", "tbl", F.lit(0).alias("w"))).join(odd, "tbl", "left_semi")
    jobs = used.groupBy("tbl", "job").agg(F.max("w").alias("w"), F.min("w").alias("r"))
    of_reports = jobs.join(reports, "job")
    local = of_reports.groupBy("rpt", "tbl").agg(F.count_if(F.col("w") == 1).alias("n_writers"), F.count_if(F.col("r") == 0).alias("n_readers")).where("n_writers > 0")
    touched = jobs.groupBy("tbl").agg(F.count(F.lit(1)).alias("n_jobs")).join(of_reports.groupBy("tbl").agg(F.count_distinct("rpt").alias("n_rpts")), "tbl")
    suggestion = F.when(F.col("kind") == "HYBRID", F.concat(F.lit(STAGING_PREFIX), F.substring(F.upper("tbl"), len(HYBRID_PREFIX) + 1, 1000))).when(F.upper("tbl").startswith(STAGING_PREFIX), F.upper("tbl")).otherwise(F.concat(F.lit(STAGING_PREFIX), F.upper("tbl")))
    blast = F.least(F.col("n_jobs") + F.col("n_rpts") - 1, F.lit(10)).cast("long")
    decision = F.when(F.col("n_rpts") > 1, "EXECUTE_GLOBAL_PROGRAM").otherwise("EXECUTE_LOCALLY")
    return local.join(odd, "tbl").join(touched, "tbl").select("rpt", "tbl", "kind", suggestion.alias("suggestion"), "n_writers", "n_readers", "n_rpts", blast.alias("blast"), decision.alias("decision"))
