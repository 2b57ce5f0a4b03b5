"""Recommendations of the load, update, chain and view detectors, with every branch of their rules.

Job names are texts. ``loads`` is (tbl, job, params, is_view): lineage rows by target; ``objects`` (job, object,
is_parameterised): the SQL objects that a job calls. Rows have the columns of ``detectors.SCHEMA`` and ``scope``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import joined, ladder
from loomgraph.functions.scratch import materialize

from .detect import is_log_table, serial_chains

# The category names, scopes and texts of the recommendations in this module are fixed values of the rules, as are the following:
# marks of source systems in job names, in the order in which they are looked for, and names of no table.
SYSTEM_MARKS = (
    ("CV", ("_CV_", "_CV-", "-CV-", "-CV_")), ("PACS", ("_PACS_", "_PACS-", "-PACS-", "-PACS_")), ("VUE", ("_VUE_", "_VUE-", "-VUE-")),
    ("APS", ("_APS_", "_APS-", "-APS-")), ("SHINKA", ("_SHINKA_", "_SHINKA-")), ("EIS", ("_EIS_", "_EIS-")),
)
NO_TABLES = ("", "None", "N/A", "-")


def source_system(job: Column) -> Column:
    """The system whose mark a job name has; null without one."""
    name = F.upper(job)
    out = F.lit(None).cast("string")
    for system, marks in reversed(SYSTEM_MARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | name.contains(m)
        out = F.when(hit, system).otherwise(out)
    return out


def scoped(groups: DataFrame, keys: list[str], objects: DataFrame) -> DataFrame:
    """(keys, n_jobs, jobs, objects, scope, systems, same_family, ...) of (keys, job): what the jobs of a group call, and how far apart that is.

    ALREADY_PARAMETERIZED: one object, called with parameters by each job; SAME_PKG_VARIANT: several of one package;
    DIFF_SQL_OBJECTS: anything else, and where nothing is known.
    """
    jobs = groups.select(*keys, "job").distinct()
    called = objects.where("object <> ''").groupBy("job").agg(F.collect_set("object").alias("own"), F.max(F.coalesce("is_parameterised", F.lit(False))).alias("given"))
    each = materialize(jobs.join(called, "job", "left").withColumn("system", source_system(F.col("job"))).withColumn("given", F.coalesce("given", F.lit(False))), "callers")
    cv, pacs = F.col("job").contains("SHINKA") | F.col("job").contains("CV"), F.col("job").contains("PACS")
    by = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_jobs"), joined(F.collect_set("job")).alias("jobs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("objects"), F.every("given").alias("all_given"),
        F.array_sort(F.collect_set("system")).alias("systems"), F.some(cv).alias("cv"), F.some(pacs).alias("pacs"),
    )
    packages = F.size(F.array_distinct(F.transform("objects", lambda o: F.split(o, r"\.")[0])))
    n = F.size("objects")
    scope = ladder([((n == 1) & F.col("all_given"), "ALREADY_PARAMETERIZED"), ((packages == 1) & (n > 1), "SAME_PKG_VARIANT")], "DIFF_SQL_OBJECTS")
    return by.withColumn("scope", scope).withColumn("split", F.size("systems") >= 2).withColumn("same_family", (F.col("scope") == "SAME_PKG_VARIANT") | (packages <= 1))


def words(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def load_recommendations(loads: DataFrame, objects: DataFrame) -> DataFrame:
    """Targets that several jobs load: by design, settled already, or one load too many.

    Loads of views, of log tables, and targets all of whose loads say MULTI_SRC in their parameters are left out.
    """
    real = loads.where(~F.coalesce("is_view", F.lit(False)) & ~F.col("tbl").isin(*NO_TABLES) & (F.col("job") != ""))
    several = real.groupBy("tbl").agg(F.every(F.contains(F.upper(F.coalesce("params", F.lit(""))), F.lit("MULTI_SRC"))).alias("meant"), F.count_distinct("job").alias("n")).where("n >= 2 and not meant").select("tbl")
    found = scoped(real.join(several.where(~is_log_table(F.col("tbl"))), "tbl", "left_semi"), ["tbl"], objects)
    settled = F.col("scope") == "ALREADY_PARAMETERIZED"
    designed = F.col("split") & (settled | F.col("same_family"))
    kind = ladder([(designed, "design"), (settled, "settled")], "redundant")
    found = materialize(found.withColumn("kind", kind), "loads")  # the texts below name these columns many times
    systems, object_list = F.array_join("systems", ", "), F.when(F.size("objects") > 0, F.array_join("objects", ", ")).otherwise("unknown")
    category = F.when(F.col("kind") == "design", "A. Source System Architectural Split (By Design)").when(F.col("kind") == "settled", "A. Already Parameterized (No Action Needed)").otherwise("A. Redundant Multi-Source Load")
    both = F.col("cv") & F.col("pacs")
    described = (
        F.when(F.col("kind") == "design", words("Table '", F.col("tbl"), "' loaded by ", F.col("n_jobs"), " jobs from distinct source systems (", systems, "); the separation is intentional, so that each can be held alone."))
        .when(F.col("kind") == "settled", words("Table '", F.col("tbl"), "' loaded by ", F.col("n_jobs"), " jobs all calling '", F.col("objects")[0], "' with different parameters; consolidation is done at SQL level."))
        .when(both, words("Table '", F.col("tbl"), "' loaded by ", F.col("n_jobs"), " jobs (CV_SHINKA + PACS). SQL objects called: ", object_list, "."))
        .otherwise(words("Table '", F.col("tbl"), "' loaded by ", F.col("n_jobs"), " jobs: ", F.col("jobs"), ". SQL: ", object_list))
    )
    advice = (
        F.when(F.col("kind") == "design", words("Do not consolidate: jobs are separated by source system (", systems, ")."))
        .when(F.col("kind") == "settled", "No SQL-level action needed. Review if the number of scheduled jobs can be reduced.")
        .when(both & (F.col("scope") == "SAME_PKG_VARIANT"), "Evaluate if the variants of the package can be unified with a source-system parameter.")
        .when(both, "Jobs call different SQL objects. Investigate if loads can be consolidated into a single parameterized procedure.")
        .otherwise("Investigate if loads can be consolidated.")
    )
    redundant = F.col("kind") == "redundant"
    scope = F.when(F.col("kind") == "design", "SOURCE_SYSTEM_SPLIT").otherwise(F.col("scope"))
    return found.select(
        category.alias("category"), F.col("tbl").alias("target_table"), described.alias("description"), F.col("jobs").alias("affected_jobs"), F.col("n_jobs").alias("current_hops"),
        F.when(redundant, F.col("n_jobs") - 1).otherwise(0).alias("savings"), F.when(redundant, "MEDIUM").otherwise("LOW").alias("risk"), advice.alias("recommendation"), scope.alias("scope"),
    )


def update_recommendations(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Jobs that read and write one table; log tables, report tables (RPT_...) and temporary ones (..._GTT) are meant to be."""
    upper = F.upper("tbl")
    both = materialize(writes.select("job", "tbl").distinct().join(reads.select("job", "tbl").distinct(), ["job", "tbl"], "left_semi"), "in-place")
    both = both.where(~is_log_table(F.col("tbl")) & ~upper.startswith("RPT_") & ~upper.endswith("_GTT"))
    by = both.groupBy("job").agg(F.array_join(F.array_sort(F.collect_set("tbl")), ", ").alias("tables"))
    return by.select(
        F.lit("B. Pass-Through / Update-in-Place").alias("category"), F.col("tables").alias("target_table"), words("Job '", F.col("job"), "' reads and writes the same table(s): ", F.col("tables"), ". This is a post-load update hop.").alias("description"),
        F.col("job").cast("string").alias("affected_jobs"), F.lit(1).alias("current_hops"), F.lit(1).alias("savings"), F.lit("MEDIUM").alias("risk"),
        F.lit("Fold UPDATE logic into the upstream INSERT/MERGE job that originally created the table rows.").alias("recommendation"), F.lit(None).cast("string").alias("scope"),
    )


def chain_recommendations(edges: DataFrame, jobs: DataFrame, writes: DataFrame, least_depth: int = 3) -> DataFrame:
    """Chains of jobs of the kind OTHER that call no SQL object and lie ``least_depth`` deep or more, unless two neighbours write a common column.

    ``jobs`` is (job, category, depth, has_object), ``writes`` (job, tbl, col). Only jobs of that kind count as neighbours.
    """
    plain = jobs.where((F.col("category") == "OTHER") & ~F.coalesce("has_object", F.lit(False)) & (F.col("depth") >= least_depth)).select("job", "depth")
    inner = edges.select("job", "dependent_job").distinct().join(plain.select("job"), "job", "left_semi").join(plain.select(F.col("job").alias("dependent_job")), "dependent_job", "left_semi")
    steps = serial_chains(inner, plain.select("job", F.lit("OTHER").alias("category"))).join(plain, "job")
    one, two = writes.select("job", "tbl", "col"), writes.select(F.col("job").alias("next"), "tbl", "col")
    neighbours = steps.select("first", "job", "step").join(steps.select("first", F.col("job").alias("next"), (F.col("step") - 1).alias("step")), ["first", "step"])
    shared = neighbours.join(one, "job").join(two, ["next", "tbl", "col"]).select("first").distinct()
    chains = steps.join(shared, "first", "left_anti").groupBy("first").agg(F.array_sort(F.collect_list(F.struct("step", "job"))).alias("c"), F.min("depth").alias("least"), F.max("depth").alias("most"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    names = F.array_join(F.transform("c", lambda s: s["job"].cast("string")), ",")
    return chains.select(
        F.lit("D. Serial Orchestration Chain (No Data Dep)").alias("category"), F.lit("N/A (orchestration only)").alias("target_table"), words("Chain of ", F.col("n"), " jobs with no overlapping column writes. Safe to parallelize.").alias("description"),
        names.alias("affected_jobs"), F.col("n").alias("current_hops"), (F.col("most") - F.col("least")).alias("savings"), F.lit("LOW").alias("risk"),
        words("Run in parallel. Critical-path depth: ", F.col("most"), " -> ", F.col("least"), ".").alias("recommendation"), F.lit(None).cast("string").alias("scope"),
    )


def view_recommendations(views: DataFrame, reads: DataFrame, writes: DataFrame, written: DataFrame, consumed: DataFrame) -> DataFrame:
    """Materialised views with one consumer, with the risk of inlining them.

    ``views`` is (job), ``reads`` and ``writes`` (job, tbl), ``written`` (job, tbl, col) the columns that jobs write, ``consumed``
    (job, tbl, col) those that they read. The risk is HIGH, MEDIUM if the consumer uses less than half of the view's columns, and
    HIGH again where the view reads four tables or more.
    """
    own = writes.join(views.select("job"), "job", "left_semi").select(F.col("job").alias("mv"), "tbl").distinct()
    used = own.join(reads.select(F.col("job").alias("consumer"), "tbl").distinct(), "tbl").where("mv <> consumer")
    single = used.groupBy("mv").agg(F.count_distinct("consumer").alias("n"), F.min("consumer").alias("consumer")).where("n = 1")
    sources = reads.groupBy(F.col("job").alias("mv")).agg(F.count_distinct("tbl").alias("n_sources"))
    columns = written.select(F.col("job").alias("mv"), "col").distinct()
    taken = single.select("mv", "consumer").join(own, "mv").join(consumed.select(F.col("job").alias("consumer"), "tbl", "col").distinct(), ["consumer", "tbl"]).select("mv", "col").distinct()
    shares = columns.join(taken.withColumn("taken", F.lit(1)), ["mv", "col"], "left").groupBy("mv").agg(F.count(F.lit(1)).alias("n_columns"), F.count("taken").alias("n_taken"))
    any_taken = taken.groupBy("mv").agg(F.count(F.lit(1)).alias("n_read"))
    tables = own.groupBy("mv").agg(F.array_join(F.array_sort(F.collect_set("tbl")), ", ").alias("tables"))
    found = single.join(tables, "mv").join(sources, "mv", "left").join(shares, "mv", "left").join(any_taken, "mv", "left").fillna(0, ["n_sources", "n_columns", "n_taken", "n_read"])
    told = (F.col("n_read") > 0) & (F.col("n_columns") > 0)
    risk = ladder([(F.col("n_sources") >= 4, "HIGH"), (told & (2 * F.col("n_taken") < F.col("n_columns")), "MEDIUM")], "HIGH")
    complexity = ladder([(F.col("n_sources") >= 4, "HIGH"), (F.col("n_sources") >= 2, "MEDIUM")], "LOW")
    note = F.when(told, words(" Consumer uses ", F.col("n_taken"), " of ", F.col("n_columns"), " columns.")).otherwise("")
    return found.select(
        F.lit("E. MV Elimination Candidate").alias("category"), F.col("tables").alias("target_table"), words("View of job '", F.col("mv"), "' has one consumer, '", F.col("consumer"), "', and reads ", F.col("n_sources"), " tables (complexity ", complexity, ").", note).alias("description"),
        words(F.col("mv"), ",", F.col("consumer")).alias("affected_jobs"), F.lit(2).alias("current_hops"), F.lit(1).alias("savings"), risk.alias("risk"),
        words("Inline the view's query into '", F.col("consumer"), "', compare row counts and key metrics over three runs, then take the refresh out of the schedule.").alias("recommendation"), F.lit("LOCAL_ONLY").alias("scope"),
    )
