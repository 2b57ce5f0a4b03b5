"""Scan clean-up and lineage fusion queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.columns import category_of, joined, ladder, nullif_any, script_name, strip_alias, strip_schema
from loomgraph.operators import fusion, graph

from .graphs import _DEPTH, report_nodes
from .registry import query


@query("a03_snapshot_scan", "SELECT pos, job, dependent_job, CASE WHEN upper(trim(params)) IN ('F', 'N/A', 'NONE', '') THEN NULL ELSE params END AS params FROM fx_edge_log")
def a03(fx):
    """Null-like texts become null."""
    return fx["fx_edge_log"].select("pos", "job", "dependent_job", nullif_any(F.col("params"), ("F", "N/A", "NONE", "")).alias("params"))


@query("a04_latest_edges", """
WITH g AS (SELECT job, dependent_job, min(pos) AS pos, arg_min(coalesce(cmd, ''), pos) AS f_cmd, arg_min(params, pos) AS f_params,
  arg_min(trim(cmd), pos) FILTER (WHERE trim(cmd) <> '') AS cmd, arg_min(trim(params), pos) FILTER (WHERE trim(params) <> '') AS params FROM fx_edge_log GROUP BY job, dependent_job)
SELECT job, dependent_job, pos, CASE WHEN trim(f_cmd) <> '' THEN f_cmd ELSE cmd END AS cmd, CASE WHEN trim(f_params) <> '' THEN f_params ELSE params END AS params FROM g
""")
def a04(fx):
    """Edges of several runs: the first row of each, with independent back-fill."""
    return fusion.latest_edges(fx["fx_edge_log"])


@query("a05_edge_merge", """
WITH p AS (SELECT pos, job, dependent_job, cmd, 'primary' AS source FROM fx_edge_log),
s AS (SELECT min(pos) AS pos, job, dependent_job, arg_min(cmd, pos) AS cmd, 'supplement' AS source FROM fx_edge_supp t
      WHERE NOT EXISTS (SELECT 1 FROM fx_edge_log e WHERE e.job = t.job AND e.dependent_job = t.dependent_job) GROUP BY job, dependent_job)
SELECT * FROM p UNION ALL SELECT * FROM s
""")
def a05(fx):
    """A primary edge set, and what only the supplement has."""
    return fusion.precedence_merge(fx["fx_edge_log"].drop("params"), fx["fx_edge_supp"], ["job", "dependent_job"])


@query("a08_object_aggregate", r"""
WITH r AS (SELECT upper(object) AS key, upper(src_table) AS s, upper(tgt_table) AS t FROM fx_parts),
p AS (SELECT regexp_replace(key, '_PART[0-9]+$', '') AS key, s, t FROM r WHERE regexp_matches(key, '_PART[0-9]+$')),
u AS (SELECT key, s, t, false AS rolled FROM r UNION ALL SELECT key, s, t, true FROM p WHERE key NOT IN (SELECT key FROM r))
SELECT key, string_agg(DISTINCT s, ',' ORDER BY s) AS src_tables, string_agg(DISTINCT t, ',' ORDER BY t) AS tgt_tables, count(*) AS n_rows, rolled FROM u GROUP BY key, rolled
""")
def a08(fx):
    """Lineage by object; parts stand in for an absent whole."""
    return fusion.object_aggregate(fx["fx_parts"])


@query("a11_last_runtime", "SELECT job, arg_max(runtime_sec, event_id) AS runtime_sec FROM fx_runs GROUP BY job")
def a11(fx):
    """The last duplicate wins."""
    return fx["fx_runs"].groupBy("job").agg(F.max_by("runtime_sec", "event_id").alias("runtime_sec"))


@query("a12_view_sources", "SELECT object AS view, string_agg(DISTINCT upper(src_table), ',' ORDER BY upper(src_table)) AS sources FROM fx_lineage WHERE ends_with(object, '7') GROUP BY object")
def a12(fx):
    """Sources of each view definition."""
    return fx["fx_lineage"].where(F.col("object").endswith("7")).groupBy(F.col("object").alias("view")).agg(joined(F.collect_set(F.upper("src_table"))).alias("sources"))


@query("a15_lineage_filter", "SELECT pos, tgt_table FROM (SELECT pos, CASE WHEN pos % 5 = 0 THEN concat(tgt_table, ',X') ELSE tgt_table END AS tgt_table FROM fx_lineage) WHERE NOT contains(tgt_table, ',')")
def a15(fx):
    """Rows whose target is a list are left out."""
    target = F.when(F.col("pos") % 5 == 0, F.concat("tgt_table", F.lit(",X"))).otherwise(F.col("tgt_table"))
    return fx["fx_lineage"].select("pos", target.alias("tgt_table")).where(~F.col("tgt_table").contains(","))


@query("a19_status_scan", "SELECT target_table, arg_max(risk, CASE WHEN rpt = 'RPT_0' THEN 1000000000 + pos ELSE -pos END) AS status FROM fx_recs GROUP BY target_table")
def a19(fx):
    """The last master row overwrites; else the first row counts."""
    rank = F.when(F.col("rpt") == "RPT_0", F.lit(1_000_000_000) + F.col("pos")).otherwise(-F.col("pos"))
    return fx["fx_recs"].groupBy("target_table").agg(F.max_by("risk", rank).alias("status"))


@query("a20_status_counts", "SELECT risk AS status, count(*) AS n, sum(coalesce(TRY_CAST(CASE WHEN pos % 9 = 0 THEN 'n/a' ELSE CAST(hops AS VARCHAR) END AS BIGINT), 0)) AS hops FROM fx_recs GROUP BY risk")
def a20(fx):
    """Counts by status with tolerant casts."""
    text = F.when(F.col("pos") % 9 == 0, "n/a").otherwise(F.col("hops").cast("string"))
    return fx["fx_recs"].groupBy(F.col("risk").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(text.try_cast("bigint"), F.lit(0))).alias("hops"))


@query("a21_leading_numbers", r"SELECT pos, CAST(nullif(regexp_extract(concat(' ', CAST(est_min AS VARCHAR), ' min (', risk, ')'), '^\s*(-?[0-9]+)', 1), '') AS BIGINT) AS minutes FROM fx_recs")
def a21(fx):
    """The number at the head of an annotated cell."""
    cell = F.concat(F.lit(" "), F.col("est_min").cast("string"), F.lit(" min ("), "risk", F.lit(")"))
    return fx["fx_recs"].select("pos", F.regexp_extract(cell, r"^\s*(-?\d+)", 1).try_cast("bigint").alias("minutes"))


@query("a22_table_info", "SELECT tgt_table, count(DISTINCT tgt_col) AS n_columns, count(*) AS n_rows, string_agg(DISTINCT tgt_col, ',' ORDER BY tgt_col) AS columns FROM fx_lineage GROUP BY tgt_table")
def a22(fx):
    """Columns and counts of each table."""
    return fx["fx_lineage"].groupBy("tgt_table").agg(F.count_distinct("tgt_col").alias("n_columns"), F.count(F.lit(1)).alias("n_rows"), joined(F.collect_set("tgt_col")).alias("columns"))


@query("d01_orphans", "SELECT job FROM fx_jobs n WHERE NOT EXISTS (SELECT 1 FROM fx_edges e JOIN fx_jobs m ON m.job = e.job WHERE e.dependent_job = n.job AND m.category <> 'RPT')")
def d01(fx):
    """Jobs on which no job of the wanted kind depends."""
    kinds = fx["fx_jobs"].where("category <> 'RPT'").select("job")
    used = fx["fx_edges"].join(kinds, "job", "left_semi").select(F.col("dependent_job").alias("job"))
    return fx["fx_jobs"].join(used, "job", "left_anti").select("job")


@query("d02_exclusions", "SELECT job, category IN ('STG', 'REF') AS disabled FROM fx_jobs WHERE sql_object NOT IN ('Brand#1', 'Brand#2') AND NOT starts_with(job_name, 'JOB_9')")
def d02(fx):
    """Excluded names go, disabled kinds are marked."""
    kept = ~F.col("sql_object").isin("Brand#1", "Brand#2") & ~F.col("job_name").startswith("JOB_9")
    return fx["fx_jobs"].where(kept).select("job", F.col("category").isin("STG", "REF").alias("disabled"))


@query("d03_combine_rows", """
SELECT n.job, l.object, CASE WHEN n.is_pass AND l.object IS NOT NULL THEN 'COMPLETE' WHEN n.is_pass THEN 'MISSING_LINEAGE' WHEN l.object IS NOT NULL THEN 'SQL_OBJECT_IDENTIFIED' ELSE 'UNRESOLVED' END AS status
FROM fx_jobs n LEFT JOIN (SELECT DISTINCT object, job FROM fx_lineage) l ON l.job = n.job
""")
def d03(fx):
    """One row per job and object, with the status of the case that applies."""
    refs = fx["fx_lineage"].select("object", "job").distinct()
    found = F.col("object").isNotNull()
    status = ladder([(F.col("is_pass") & found, "COMPLETE"), (F.col("is_pass"), "MISSING_LINEAGE"), (found, "SQL_OBJECT_IDENTIFIED")], "UNRESOLVED")
    return fx["fx_jobs"].join(refs, "job", "left").select("job", "object", status.alias("status"))


@query("d04_command_script", r"SELECT script, regexp_extract(concat('/opt/jobs/run_', CAST(script % 19 AS VARCHAR), CASE WHEN script % 3 = 0 THEN '.sh' ELSE '.ksh' END, ' a b'), '(?i)([^\s/\\]+\.(?:sh|sql|exe))(?:\s|$)', 1) AS name FROM fx_scripts")
def d04(fx):
    """The script's name of a command line."""
    command = F.concat(F.lit("/opt/jobs/run_"), (F.col("script") % 19).cast("string"), F.when(F.col("script") % 3 == 0, ".sh").otherwise(".ksh"), F.lit(" a b"))
    return fx["fx_scripts"].select("script", script_name(command).alias("name"))


@query("d07_categories", """
SELECT tgt, CASE WHEN starts_with(tgt, 'RPT') THEN 'RPT' WHEN starts_with(tgt, 'MV') THEN 'MV' WHEN starts_with(tgt, 'FCT') THEN 'FCT' WHEN starts_with(tgt, 'DIM') THEN 'DIM' WHEN starts_with(tgt, 'STG') THEN 'STG' WHEN starts_with(tgt, 'REF') THEN 'REF' ELSE 'OTHER' END AS kind, count(*) AS n
FROM (SELECT concat(category, '_', job_name) AS tgt FROM fx_jobs) GROUP BY tgt
""")
def d07(fx):
    """A job's kind by the first prefix of its name that fits."""
    name = F.concat_ws("_", "category", "job_name")
    return fx["fx_jobs"].select(name.alias("tgt")).groupBy("tgt").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", category_of(F.col("tgt")))


_DEPTHS = _DEPTH.format(frm="job", to="dependent_job", more="").strip()


@query("d08_attach_depth", f"SELECT r.rpt, n.job, d.depth FROM fx_roots r CROSS JOIN (SELECT job FROM fx_jobs) n LEFT JOIN ({_DEPTHS}) d ON d.root = r.root_job AND d.node = n.job")
def d08(fx):
    """The depth of each job in each report, null where it isn't reached. The five reports are the small side."""
    depth = graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"])
    jobs = fx["fx_jobs"].select("job", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i"))
    roots = fx["fx_roots"].withColumn("i", (F.col("root_job") - 1).cast("int"))
    return jobs.join(roots, "i").join(depth, (F.col("root") == F.col("root_job")) & (F.col("node") == F.col("job")), "left").select("rpt", "job", "depth")


_BORROW = "SELECT pos, src_table AS root, tgt_table, CASE WHEN pos % 3 = 0 THEN CAST(pos % 9 AS BIGINT) END AS depth FROM fx_lineage"


@query("d09_borrow_depth", f"WITH r AS ({_BORROW}) SELECT pos, root, tgt_table, depth, coalesce(depth, (SELECT arg_min(s.depth, s.pos) FROM r s WHERE s.root = r.root AND s.tgt_table = r.tgt_table AND s.depth IS NOT NULL)) AS filled FROM r")
def d09(fx):
    """Rows without a depth take that of the first sibling."""
    rows = fx["fx_lineage"].select("pos", F.col("src_table").alias("root"), "tgt_table", F.when(F.col("pos") % 3 == 0, (F.col("pos") % 9).cast("bigint")).alias("depth"))
    return fusion.borrow_depth(rows)


@query("d10_missing_jobs", f"SELECT r.rpt, d.node AS job, CASE WHEN d.depth = 0 THEN 'ROOT_JOB_ENTRY' ELSE 'RECURSIVE_BFS' END AS lineage_source FROM ({_DEPTHS}) d JOIN fx_roots r ON r.root_job = d.root WHERE NOT EXISTS (SELECT 1 FROM fx_reads x WHERE x.job = d.node)")
def d10(fx):
    """Reached jobs that the schema lacks."""
    nodes = report_nodes(fx).join(fx["fx_reads"].select(F.col("job").alias("node")), "node", "left_anti")
    return nodes.select("rpt", F.col("node").alias("job"), F.when(F.col("depth") == 0, "ROOT_JOB_ENTRY").otherwise("RECURSIVE_BFS").alias("lineage_source"))


@query("d12_package_expansion", """
SELECT object AS package, c.child, CAST(c.step AS BIGINT) AS step FROM (SELECT DISTINCT object FROM fx_lineage) CROSS JOIN (VALUES (1, 'LOAD'), (2, 'MERGE'), (3, 'CLEAN')) c(step, child) WHERE NOT ends_with(object, '3')
UNION ALL SELECT DISTINCT object, 'MAIN', CAST(0 AS BIGINT) FROM fx_lineage
""")
def d12(fx):
    """A marker row per package, and one per called procedure."""
    packages = fx["fx_lineage"].select(F.col("object").alias("package")).distinct()
    calls = F.when(F.col("package").endswith("3"), F.array(F.lit("MAIN"))).otherwise(F.array(*map(F.lit, ("MAIN", "LOAD", "MERGE", "CLEAN"))))
    return packages.select("package", F.posexplode(calls).alias("step", "child")).withColumn("step", F.col("step").cast("bigint"))


@query("d14_neighbours", """
WITH u AS (SELECT job AS node, string_agg(DISTINCT lpad(CAST(dependent_job AS VARCHAR), 9, '0'), ' | ' ORDER BY lpad(CAST(dependent_job AS VARCHAR), 9, '0')) AS upstream FROM fx_edges GROUP BY job),
d AS (SELECT dependent_job AS node, string_agg(DISTINCT lpad(CAST(job AS VARCHAR), 9, '0'), ' | ' ORDER BY lpad(CAST(job AS VARCHAR), 9, '0')) AS downstream FROM fx_edges GROUP BY dependent_job)
SELECT coalesce(u.node, d.node) AS node, coalesce(upstream, '') AS upstream, coalesce(downstream, '') AS downstream FROM u FULL JOIN d ON u.node = d.node
""")
def d14(fx):
    """Jobs right before and right after each job."""
    return fusion.neighbour_lists(fx["fx_edges"])


@query("d15_lookup_precedence", """
WITH a AS (SELECT object, min(tgt_table) AS t FROM fx_lineage GROUP BY object), b AS (SELECT object, min(tgt_table) AS t FROM fx_lineage_alt GROUP BY object)
SELECT coalesce(a.object, b.object) AS object, coalesce(a.t, b.t) AS tgt_table, CASE WHEN a.t IS NOT NULL THEN 'first' ELSE 'second' END AS taken_from FROM a FULL JOIN b ON a.object = b.object
""")
def d15(fx):
    """The parser's lineage overrides the other by object."""
    least = lambda n: fx[n].groupBy("object").agg(F.min("tgt_table").alias("tgt_table"))
    return fusion.override_merge(least("fx_lineage"), least("fx_lineage_alt"), "object", "tgt_table")


@query("d16_key_cascade", """
WITH l AS (SELECT object AS key, count(*) AS n FROM fx_lineage GROUP BY object),
c AS (SELECT job, 0 AS priority, concat('OBJ_', CAST(job * 3 AS VARCHAR)) AS key FROM fx_jobs UNION ALL SELECT job, 1, CASE WHEN job % 2 = 0 THEN concat('OBJ_', CAST(job AS VARCHAR)) END FROM fx_jobs UNION ALL SELECT job, 2, concat('OBJ_', CAST(job % 70 AS VARCHAR)) FROM fx_jobs),
h AS (SELECT job, arg_min(key, priority) AS key, CAST(min(priority) AS INTEGER) AS priority, arg_min(n, priority) AS n FROM c JOIN l USING (key) GROUP BY job)
SELECT j.job, h.priority, h.key, h.n FROM fx_jobs j LEFT JOIN h USING (job)
""")
def d16(fx):
    """Ordered candidate keys; the first that the lookup has counts."""
    name = lambda c: F.concat(F.lit("OBJ_"), c.cast("string"))
    job = F.col("job")
    lookup = fx["fx_lineage"].groupBy("object").agg(F.count(F.lit(1)).alias("n"))
    return fusion.key_cascade(fx["fx_jobs"].select("job"), "job", [name(job * 3), F.when(job % 2 == 0, name(job)), name(job % 70)], lookup, "object")


@query("d17_enrichment", """
SELECT j.job, coalesce(w.tbl, l.tgt_table) AS tgt_table, CASE WHEN w.tbl IS NOT NULL THEN 'KEPT' WHEN l.tgt_table IS NOT NULL THEN 'COMPLETE' ELSE 'NEEDS_INVESTIGATION' END AS status
FROM fx_jobs j LEFT JOIN (SELECT job, min(tbl) AS tbl FROM fx_writes WHERE job % 2 = 0 GROUP BY job) w USING (job)
LEFT JOIN (SELECT job, arg_min(tgt_table, pos) AS tgt_table FROM fx_lineage GROUP BY job) l USING (job)
""")
def d17(fx):
    """Existing targets stay; others are filled from the lineage and their status rises."""
    own = fx["fx_writes"].where("job % 2 = 0").groupBy("job").agg(F.min("tbl").alias("own"))
    found = fx["fx_lineage"].groupBy("job").agg(F.min_by("tgt_table", "pos").alias("found"))
    status = ladder([(F.col("own").isNotNull(), "KEPT"), (F.col("found").isNotNull(), "COMPLETE")], "NEEDS_INVESTIGATION")
    return fx["fx_jobs"].select("job").join(own, "job", "left").join(found, "job", "left").select("job", F.coalesce("own", "found").alias("tgt_table"), status.alias("status"))


@query("d19_view_expansion", """
WITH RECURSIVE def AS (SELECT DISTINCT concat('SRC_', CAST(job % 60 AS VARCHAR)) AS view, concat('SRC_', CAST(dependent_job % 60 AS VARCHAR)) AS source FROM fx_edges),
seed AS (SELECT concat('RPT_', CAST(job % 3 AS VARCHAR)) AS rpt, src_table AS view, CAST(min(job % 4) AS INTEGER) AS depth FROM fx_lineage WHERE src_table IN (SELECT view FROM def) GROUP BY ALL),
v(rpt, view, depth) AS (SELECT rpt, view, depth FROM seed UNION SELECT v.rpt, d.source, v.depth + 1 FROM v JOIN def d ON d.view = v.view WHERE d.source IN (SELECT view FROM def) AND v.depth < 60)
SELECT rpt, view, CAST(min(depth) AS INTEGER) AS depth FROM v GROUP BY rpt, view
""")
def d19(fx):
    """Views used by the report and, step by step, by its views."""
    name = lambda c: F.concat(F.lit("SRC_"), (F.col(c) % 60).cast("string"))
    definitions = fx["fx_edges"].select(name("job").alias("view"), name("dependent_job").alias("source")).distinct()
    views = definitions.select(F.col("view").alias("src_table")).distinct()
    seeds = fx["fx_lineage"].join(views, "src_table", "left_semi").select(F.concat(F.lit("RPT_"), (F.col("job") % 3).cast("string")).alias("rpt"), F.col("src_table").alias("view"), (F.col("job") % 4).cast("int").alias("depth"))
    return fusion.expand_views(seeds, definitions)


@query("d20_runtimes", "SELECT n.job, r.mean_sec FROM fx_jobs n LEFT JOIN (SELECT job, round(avg(runtime_sec), 4) AS mean_sec FROM fx_runs GROUP BY job) r USING (job)")
def d20(fx):
    """Mean runtimes joined to the jobs."""
    means = fx["fx_runs"].groupBy("job").agg(F.round(F.avg("runtime_sec"), 4).alias("mean_sec"))
    return fx["fx_jobs"].select("job").join(means, "job", "left")


@query("d21_column_pairs", """
WITH r AS (SELECT pos, concat(src_col, ',K9') AS s, concat(tgt_col, ',X,Y') AS t FROM fx_lineage)
SELECT pos, CAST(i - 1 AS INTEGER) AS at, coalesce(trim(string_split(s, ',')[i]), '') AS source_column, trim(string_split(t, ',')[i]) AS target_column FROM r, (SELECT unnest([1, 2, 3]) AS i)
""")
def d21(fx):
    """Columns paired by place."""
    rows = fx["fx_lineage"].select("pos", F.concat("src_col", F.lit(",K9")).alias("s"), F.concat("tgt_col", F.lit(",X,Y")).alias("t"))
    return fusion.paired_columns(rows, "s", "t").select("pos", "at", "source_column", "target_column")


@query("d22_gaps", "SELECT pos, object FROM fx_lineage WHERE transformation IN ('NVL', 'Constant / Expression') AND src_col IN ('', 'K1')")
def d22(fx):
    return fx["fx_lineage"].where(F.col("transformation").isin("NVL", "Constant / Expression") & F.col("src_col").isin("", "K1")).select("pos", "object")


_SUMMARY = "count(*) AS total, count(*) FILTER (WHERE transformation = 'Direct') AS complete, count(*) FILTER (WHERE transformation = 'NVL') AS partial, count(DISTINCT object) AS n_objects"


@query("d23_report_summary", f"SELECT src_table AS rpt, {_SUMMARY}, round(100.0 * count(*) FILTER (WHERE transformation = 'Direct') / count(*), 1) AS completion_pct FROM fx_lineage GROUP BY src_table")
def d23(fx):
    """Conditional counts of each report, and the share that is complete."""
    direct = F.count_if(F.col("transformation") == "Direct")
    total = F.count(F.lit(1))
    return fx["fx_lineage"].groupBy(F.col("src_table").alias("rpt")).agg(
        total.alias("total"), direct.alias("complete"), F.count_if(F.col("transformation") == "NVL").alias("partial"), F.count_distinct("object").alias("n_objects"), F.round(100.0 * direct / total, 1).alias("completion_pct")
    )


@query("d24_status_shares", "SELECT transformation AS status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fx_lineage), 2) AS pct FROM fx_lineage GROUP BY transformation")
def d24(fx):
    """Shares of each status; the total is one row."""
    from pyspark.sql import Window

    by = fx["fx_lineage"].groupBy(F.col("transformation").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("d25_name_parts", r"SELECT DISTINCT upper(regexp_replace(regexp_replace(trim(concat(' own.', tgt_table, '@link')), '@.*$', ''), '^.*\.', '')) AS bare, regexp_extract(trim(concat(src_table, ' a')), '^(\S*)', 1) AS unaliased FROM fx_lineage")
def d25(fx):
    """Names without schema, link or alias."""
    bare = strip_schema(F.concat(F.lit(" own."), "tgt_table", F.lit("@link")))
    return fx["fx_lineage"].select(bare.alias("bare"), strip_alias(F.concat("src_table", F.lit(" a"))).alias("unaliased")).distinct()


@query("a10_package_calls", "SELECT object AS package, CAST(step AS INTEGER) AS step, child FROM (SELECT DISTINCT object FROM fx_lineage) CROSS JOIN (VALUES (0, 'LOAD'), (1, 'MERGE'), (2, 'CLEAN'), (3, 'EXTRA')) v(step, child)")
def a10(fx):
    """Called procedures in order, then those that are not called; utilities are left out."""
    packages = fx["fx_lineage"].select(F.col("object").alias("package")).distinct()
    called = F.transform(F.split(F.lit("LOAD → MERGE, CLEAN,LOG_START"), r"\s*[→,]\s*"), F.trim)
    listed = F.filter(F.array_union(called, F.array(F.lit("CLEAN"), F.lit("EXTRA"))), lambda x: ~x.startswith("LOG_"))
    return packages.select("package", F.posexplode(listed).alias("step", "child"))


@query("d05_parameters", "SELECT pos, upper(trim(coalesce(nullif(params, ''), nullif(cmd, ''), 'DEFAULT'), '''')) AS object FROM fx_edge_log")
def d05(fx):
    """The object that a command's parameters name: the first that is given, without quotes."""
    given = F.coalesce(F.nullif("params", F.lit("")), F.nullif("cmd", F.lit("")), F.lit("DEFAULT"))
    return fx["fx_edge_log"].select("pos", F.upper(F.regexp_replace(given, "^'+|'+$", "")).alias("object"))


@query("d06_object_keys", "SELECT job, CASE WHEN is_pass THEN concat(sql_object, '.', job_name) WHEN job % 2 = 0 THEN sql_object ELSE job_name END AS full_object FROM fx_jobs")
def d06(fx):
    """The full key of an object: package and procedure, else the one that there is."""
    pair = F.when(F.col("is_pass"), F.concat_ws(".", "sql_object", "job_name"))
    return fx["fx_jobs"].select("job", F.coalesce(pair, F.when(F.col("job") % 2 == 0, F.col("sql_object")), F.col("job_name")).alias("full_object"))


#: The first word of the parameters without a pair of quotes, as the oracle says it.
_WORD = "string_split(trim(params), ' ')[1]"
_FIRST = f"CASE WHEN trim(coalesce(params, '')) = '' THEN NULL WHEN length({_WORD}) >= 2 AND ascii({_WORD}) IN (34, 39) AND left({_WORD}, 1) = right({_WORD}, 1) THEN {_WORD}[2:-2] ELSE {_WORD} END"


@query("d05_resolved_names", f"SELECT pos, CASE WHEN pattern <> 'STATIC_SQL' OR contains(name, '$') THEN coalesce({_FIRST}, name) ELSE name END AS resolved, coalesce({_FIRST}, 'PKG_FRAMEWORK') AS package FROM (SELECT *, coalesce(procedure, 'NONE') AS name FROM fx_commands)")
def d05_resolved(fx):
    """What a name taken from parameters stands for, by the pattern of the command, and the framework's package."""
    name = F.coalesce("procedure", F.lit("NONE"))
    return fx["fx_commands"].select("pos", fusion.resolved_name(name, F.col("pattern"), F.col("params")).alias("resolved"), fusion.framework_package(F.col("params"), "PKG_FRAMEWORK").alias("package"))


@query("d06_full_objects", f"""
WITH c AS (SELECT pos, trim(coalesce(package, '')) AS g, trim(coalesce(procedure, '')) AS p, {_FIRST} AS first, trim(string_split(coalesce(shell_tables, ''), ',')[1]) AS t FROM fx_commands),
k AS (SELECT pos, CASE WHEN upper(g) = 'DBMS_MVIEW' THEN '' ELSE g END AS g, p, first, t FROM c)
SELECT pos, CASE WHEN starts_with(upper(p), 'V_') OR starts_with(p, '$') OR starts_with(p, '(') THEN coalesce(first, p) WHEN g <> '' AND p <> '' THEN concat(g, '.', p) WHEN g <> '' THEN g WHEN p <> '' THEN p ELSE t END AS full_object FROM k
""")
def d06_objects(fx):
    """The full key of each command's object, placeholders and fallbacks included."""
    c = F.col
    return fx["fx_commands"].select("pos", fusion.full_object(c("package"), c("procedure"), c("params"), c("shell_tables")).alias("full_object"))


@query("d11_forward_consumers", _DEPTH.format(frm="dependent_job", to="job", more="AND r.node <> r.root AND r.node NOT IN (SELECT job FROM fx_reads)").replace("root_job, root_job, 0 FROM fx_roots", "job, job, 0 FROM fx_jobs"))
def d11(fx):
    """Consumers that the schema lacks, with their forward depth."""
    starts = fx["fx_jobs"].select(F.col("job").alias("root_job"))
    depth = graph.weighted_depth(graph.reversed_edges(fx["fx_edges"]), fx["fx_jobs"], starts).where("node <> root")
    return depth.join(fx["fx_reads"].select(F.col("job").alias("node")), "node", "left_anti").select("root", "node", "depth")


@query("d13_row_order", f"WITH d AS ({_DEPTHS}) SELECT root, node, CAST(row_number() OVER (PARTITION BY root ORDER BY CASE WHEN depth > 4 THEN 999 ELSE depth END, node) AS BIGINT) AS place FROM d")
def d13(fx):
    """Order inside each report, jobs without a (small) depth last."""
    from pyspark.sql import Window

    depth = graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"])
    known = F.when(F.col("depth") <= 4, F.col("depth"))
    w = Window.partitionBy("root").orderBy(F.coalesce(known, F.lit(999)), "node")
    return depth.select("root", "node", F.row_number().over(w).cast("bigint").alias("place"))


@query("d18_static_enrichment", "SELECT n.job, CASE n.sql_object WHEN 'Brand#3' THEN 'AUDIT' WHEN 'Brand#4' THEN 'PURGE' END AS static_target, n.sql_object IN ('Brand#3', 'Brand#4') AS tagged FROM fx_jobs n")
def d18(fx):
    """Known packages take their targets from a configured list (two rows here)."""
    dim = fx.spark.createDataFrame([("Brand#3", "AUDIT"), ("Brand#4", "PURGE")], "sql_object string, static_target string")
    joined_rows = fx["fx_jobs"].join(F.broadcast(dim), "sql_object", "left")
    return joined_rows.select("job", "static_target", F.col("static_target").isNotNull().alias("tagged"))
