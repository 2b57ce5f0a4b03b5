"""Detector queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scratch import materialize
from loomgraph.operators import detect, summaries

from . import registry
from .registry import query

_NAME = "lpad(CAST(job AS VARCHAR), 9, '0')"
_FLOW = "SELECT DISTINCT r.tbl AS s, w.tbl AS t FROM fx_reads r JOIN fx_writes w ON r.job = w.job WHERE r.tbl <> w.tbl"


@query("f01_multi_source_loads", f"SELECT tbl, count(DISTINCT job) AS n_jobs, string_agg(DISTINCT {_NAME}, ',' ORDER BY {_NAME}) AS jobs, count(DISTINCT job) - 1 AS savings FROM fx_writes GROUP BY tbl HAVING count(DISTINCT job) >= 2")
def f01(fx):
    return detect.multi_source_loads(fx["fx_writes"])


@query("f02_updates_in_place", "SELECT DISTINCT w.job, w.tbl FROM fx_writes w JOIN fx_reads r ON r.job = w.job AND r.tbl = w.tbl")
def f02(fx):
    return detect.updates_in_place(fx["fx_reads"], fx["fx_writes"])


_TABLES = "SELECT pos, job, concat('TBL_', CAST(pos % 2000 AS VARCHAR)) AS src_table, tgt_table, tgt_col, src_col FROM fx_lineage"


def _wide(fx):
    return fx["fx_lineage"].withColumn("src_table", F.concat(F.lit("TBL_"), (F.col("pos") % 2000).cast("string")))


@query("f03_pass_through", f"""
WITH x AS ({_TABLES}), p AS (SELECT tbl, min(job) AS producer FROM fx_writes GROUP BY tbl HAVING count(DISTINCT job) = 1), c AS (SELECT tbl, min(job) AS consumer FROM fx_reads GROUP BY tbl HAVING count(DISTINCT job) = 1),
w AS (SELECT src_table AS tbl, count(DISTINCT concat(tgt_table, '.', tgt_col)) AS n_columns FROM x GROUP BY src_table)
SELECT tbl, producer, consumer, n_columns FROM p JOIN c USING (tbl) JOIN w USING (tbl) WHERE producer <> consumer AND n_columns >= 5
""")
def f03(fx):
    return detect.pass_through_tables(fx["fx_writes"], fx["fx_reads"], _wide(fx))


@query("f04_similar_jobs", """
WITH c AS (SELECT DISTINCT tgt_table, job, tgt_col FROM fx_lineage), n AS (SELECT tgt_table, job, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT a.tgt_table, a.job AS job_a, b.job AS job_b, count(*) AS shared FROM c a JOIN c b ON a.tgt_table = b.tgt_table AND a.tgt_col = b.tgt_col AND a.job < b.job GROUP BY ALL)
SELECT s.* FROM s JOIN n x ON x.tgt_table = s.tgt_table AND x.job = job_a JOIN n y ON y.tgt_table = s.tgt_table AND y.job = job_b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
""")
def f04(fx):
    return detect.similar_jobs(fx["fx_lineage"])


@query("f04_similar_sets", """
WITH m AS (SELECT tgt_table, job, string_agg(DISTINCT tgt_col, ',' ORDER BY tgt_col) AS columns FROM fx_lineage GROUP BY tgt_table, job), c AS (SELECT tgt_table, columns, count(*) AS n_jobs FROM m GROUP BY tgt_table, columns),
e AS (SELECT tgt_table, columns, unnest(string_split(columns, ',')) AS col FROM c), s AS (SELECT a.tgt_table, a.columns AS columns_a, b.columns AS columns_b, count(*) AS shared FROM e a JOIN e b ON a.tgt_table = b.tgt_table AND a.col = b.col GROUP BY ALL)
SELECT s.tgt_table, columns_a, columns_b, shared, c.n_jobs FROM s JOIN c ON c.tgt_table = s.tgt_table AND c.columns = columns_a WHERE 100 * shared >= 85 * (len(string_split(columns_a, ',')) + len(string_split(columns_b, ',')) - shared)
""")
def f04_sets(fx):
    """Similar column sets with their numbers of jobs."""
    members, pairs = detect.similar_sets(fx["fx_lineage"])
    sizes = members.groupBy("tgt_table", F.col("columns").alias("columns_a")).agg(F.count(F.lit(1)).alias("n_jobs"))
    text = lambda c: F.array_join(c, ",").alias(c)
    return pairs.join(sizes, ["tgt_table", "columns_a"]).select("tgt_table", text("columns_a"), text("columns_b"), "shared", "n_jobs")


@query("f04_similar_clusters")
def f04_clusters(fx):
    return detect.similar_clusters(fx["fx_lineage"])


@query("f04_wide_clusters")
def f04_wide_clusters(fx):
    """Clusters of hundreds of column sets a target, most of them similar to many others."""
    return detect.similar_clusters(fx["fx_wide_lineage"])


@query("f05_serial_chains", """
WITH RECURSIVE e AS (SELECT job, job + 1 AS dependent_job FROM fx_jobs WHERE job % 7 <> 0 UNION SELECT job, dependent_job FROM fx_edges WHERE job % 7 = 0),
k AS (SELECT job, CASE WHEN job % 3 = 0 THEN 'FCT' ELSE 'OTHER' END AS category FROM fx_jobs),
l AS (SELECT e.job, e.dependent_job FROM e JOIN k a ON a.job = e.job AND a.category = 'OTHER' JOIN k b ON b.job = e.dependent_job AND b.category = 'OTHER'
  WHERE (SELECT count(*) FROM e x WHERE x.job = e.job) = 1 AND (SELECT count(*) FROM e x WHERE x.dependent_job = e.dependent_job) = 1),
c(first, job, step) AS (SELECT job, job, 0 FROM l WHERE job NOT IN (SELECT dependent_job FROM l) UNION ALL SELECT c.first, l.dependent_job, c.step + 1 FROM c JOIN l ON l.job = c.job)
SELECT first, job, CAST(step AS INTEGER) AS step FROM c
""")
def f05(fx):
    jobs = fx["fx_jobs"]
    edges = jobs.where("job % 7 <> 0").select("job", (F.col("job") + 1).alias("dependent_job")).union(fx["fx_edges"].where("job % 7 = 0")).distinct()
    return detect.serial_chains(edges, jobs.select("job", F.when(F.col("job") % 3 == 0, "FCT").otherwise("OTHER").alias("category")))


@query("f06_view_consumers", f"""
WITH u AS (SELECT DISTINCT w.job AS mv, r.job FROM fx_writes w JOIN fx_jobs n ON n.job = w.job AND n.category = 'MV' JOIN fx_reads r ON r.tbl = w.tbl WHERE r.job <> w.job)
SELECT mv, count(*) AS n_consumers, string_agg({_NAME}, ',' ORDER BY {_NAME}) AS consumers, CASE WHEN count(*) > 1 THEN 'SHARED' ELSE 'ELIMINATE' END AS kind, CASE WHEN count(*) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, least(count(*), 10) AS blast FROM u GROUP BY mv
""")
def f06(fx):
    return detect.view_consumers(fx["fx_edges"], fx["fx_jobs"], fx["fx_reads"], fx["fx_writes"])


@query("f07_single_consumer_views", """
WITH u AS (SELECT DISTINCT w.job AS mv, r.job FROM fx_writes w JOIN fx_jobs n ON n.job = w.job AND n.category = 'MV' JOIN fx_reads r ON r.tbl = w.tbl WHERE r.job <> w.job),
s AS (SELECT mv, min(job) AS consumer FROM u GROUP BY mv HAVING count(*) = 1), n AS (SELECT job, count(DISTINCT tbl) AS n_sources FROM fx_reads GROUP BY job)
SELECT mv, consumer, coalesce(n_sources, 0) AS n_sources, CASE WHEN coalesce(n_sources, 0) >= 4 THEN 'HIGH' WHEN coalesce(n_sources, 0) < 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM s LEFT JOIN n ON n.job = s.mv
""")
def f07(fx):
    used = detect.view_consumers(fx["fx_edges"], fx["fx_jobs"], fx["fx_reads"], fx["fx_writes"]).where("n_consumers = 1")
    sources = fx["fx_reads"].groupBy(F.col("job").alias("mv")).agg(F.count_distinct("tbl").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return used.join(sources, "mv", "left").select("mv", F.col("consumers").cast("bigint").alias("consumer"), n.alias("n_sources"), F.when(n >= 4, "HIGH").when(n < 2, "MEDIUM").otherwise("HIGH").alias("risk"))


@query("f08_unread_with_updater", """
SELECT DISTINCT w.job AS mv, e.job AS updater FROM fx_writes w JOIN fx_jobs n ON n.job = w.job AND n.category = 'MV' JOIN fx_edges e ON e.dependent_job = w.job JOIN fx_jobs u ON u.job = e.job AND u.is_pass
WHERE NOT EXISTS (SELECT 1 FROM fx_reads r WHERE r.tbl = w.tbl)
""")
def f08(fx):
    """Views that nothing reads, whose dependent is an updater."""
    views = fx["fx_jobs"].where("category = 'MV'").select("job")
    unread = detect.unread_tables(fx["fx_writes"].join(views, "job", "left_semi"), fx["fx_reads"]).select(F.col("job").alias("mv")).distinct()
    updaters = fx["fx_edges"].join(fx["fx_jobs"].where("is_pass").select("job"), "job", "left_semi").select(F.col("job").alias("updater"), F.col("dependent_job").alias("mv"))
    return unread.join(updaters, "mv").distinct()


@query("f09_dead_views", "SELECT w.job, w.tbl FROM fx_writes w JOIN fx_jobs n ON n.job = w.job AND n.category = 'MV' WHERE NOT EXISTS (SELECT 1 FROM fx_reads r WHERE r.tbl = w.tbl) AND NOT EXISTS (SELECT 1 FROM fx_lineage l WHERE l.src_table = replace(w.tbl, 'TBL', 'SRC'))")
def f09(fx):
    """Views that nothing reads and no lineage mentions."""
    views = fx["fx_writes"].join(fx["fx_jobs"].where("category = 'MV'").select("job"), "job", "left_semi")
    named = fx["fx_lineage"].select(F.replace("src_table", F.lit("SRC"), F.lit("TBL")).alias("tbl")).distinct()
    return detect.unread_tables(views, fx["fx_reads"]).join(named, "tbl", "left_anti").select("job", "tbl")


@query("f11_indicator_chains", f"SELECT e.job, count(*) AS n_views, string_agg(lpad(CAST(e.dependent_job AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(e.dependent_job AS VARCHAR), 9, '0')) AS views FROM fx_edges e JOIN fx_jobs u ON u.job = e.job AND u.is_pass JOIN fx_jobs v ON v.job = e.dependent_job AND v.category = 'MV' GROUP BY e.job")
def f11(fx):
    """Updaters with the views that they wait for."""
    from loomgraph.functions.columns import joined

    pairs = fx["fx_edges"].join(fx["fx_jobs"].where("is_pass").select("job"), "job", "left_semi").join(fx["fx_jobs"].where("category = 'MV'").select(F.col("job").alias("dependent_job")), "dependent_job", "left_semi")
    return pairs.groupBy("job").agg(F.count(F.lit(1)).alias("n_views"), joined(F.collect_set(F.lpad(F.col("dependent_job").cast("string"), 9, "0"))).alias("views"))


@query("f13_duplicated_flows", """
WITH f AS (SELECT src_table, src_col, tgt_table, tgt_col, count(DISTINCT job) AS n FROM fx_lineage WHERE src_col <> '' GROUP BY ALL HAVING count(DISTINCT job) > 1)
SELECT src_table, tgt_table, count(*) AS n_flows, max(n) AS most_jobs FROM f GROUP BY src_table, tgt_table
""")
def f13(fx):
    return detect.duplicated_flows(fx["fx_lineage"])


@query("f14_unused_intermediates", """
SELECT w.tbl, CASE WHEN bool_or(n.category IN ('DIM', 'FCT')) THEN 'MEDIUM' ELSE 'HIGH' END AS risk, count(*) AS n_writers FROM fx_writes w JOIN fx_jobs n ON n.job = w.job
WHERE NOT EXISTS (SELECT 1 FROM fx_reads r WHERE r.tbl = w.tbl) AND w.tbl NOT IN (SELECT x.tbl FROM fx_writes x JOIN fx_jobs m ON m.job = x.job WHERE m.category = 'RPT')
GROUP BY w.tbl HAVING NOT bool_or(EXISTS (SELECT 1 FROM fx_edges e WHERE e.dependent_job = w.job AND e.job % 5 = 0))
""")
def f14(fx):
    """Written tables without a reader, a report or a job that waits for their writers."""
    marked = detect.unread_tables(fx["fx_writes"], fx["fx_reads"]).join(fx["fx_jobs"].select("job", "category"), "job")
    waits = fx["fx_edges"].where("job % 5 = 0").select(F.col("dependent_job").alias("job")).distinct().withColumn("awaited", F.lit(True))
    by = marked.join(waits, "job", "left").groupBy("tbl").agg(F.count(F.lit(1)).alias("n_writers"), F.bool_or(F.col("category").isin("DIM", "FCT")).alias("base"), F.bool_or(F.coalesce("awaited", F.lit(False))).alias("awaited"), F.bool_or(F.col("category") == "RPT").alias("report"))
    return by.where("not awaited and not report").select("tbl", F.when(F.col("base"), "MEDIUM").otherwise("HIGH").alias("risk"), "n_writers")


@query("f16_wide_views", "SELECT e.job AS mv, count(*) AS n_children FROM fx_edges e JOIN fx_jobs n ON n.job = e.job AND n.category = 'MV' GROUP BY 1 HAVING count(*) >= 5")
def f16(fx):
    """Views with five jobs or more below them."""
    views = fx["fx_jobs"].where("category = 'MV'").select("job")
    return fx["fx_edges"].join(views, "job", "left_semi").groupBy(F.col("job").alias("mv")).agg(F.count(F.lit(1)).alias("n_children")).where("n_children >= 5")


_MAPPED = "SELECT job % 8 AS job, concat('S', CAST(pos % 3 AS VARCHAR)) AS src_table, tgt_table, src_col, 'C1' AS tgt_col FROM fx_lineage"


@query("f17_identical_mappings", f"""
WITH x AS ({_MAPPED}), p AS (SELECT src_table, tgt_table, job, string_agg(DISTINCT concat(src_col, '>', tgt_col), ',' ORDER BY concat(src_col, '>', tgt_col)) AS mapping, count(DISTINCT concat(src_col, '>', tgt_col)) AS n_pairs FROM x WHERE src_col <> '' GROUP BY ALL)
SELECT src_table, tgt_table, mapping, count(*) AS n_jobs, string_agg({_NAME}, ',' ORDER BY {_NAME}) AS jobs FROM p WHERE n_pairs >= 3 GROUP BY src_table, tgt_table, mapping HAVING count(*) >= 2
""")
def f17(fx):
    rows = fx["fx_lineage"].select((F.col("job") % 8).alias("job"), F.concat(F.lit("S"), (F.col("pos") % 3).cast("string")).alias("src_table"), "tgt_table", "src_col", F.lit("C1").alias("tgt_col"))
    return detect.identical_mappings(rows)


@query("f18_staging_names", f"SELECT tbl, count(DISTINCT w.job) AS n_jobs FROM fx_writes w JOIN fx_jobs n ON n.job = w.job WHERE regexp_matches(concat(category, '_', job_name), 'MV_REFRESH|PREP|STG|STAGE|WRK|WORK|TEMP') GROUP BY tbl HAVING count(DISTINCT w.job) >= 2")
def f18(fx):
    """Targets of several jobs with staging names."""
    staged = fx["fx_jobs"].where(F.concat_ws("_", "category", "job_name").rlike("MV_REFRESH|PREP|STG|STAGE|WRK|WORK|TEMP")).select("job")
    return fx["fx_writes"].join(staged, "job", "left_semi").groupBy("tbl").agg(F.count_distinct("job").alias("n_jobs")).where("n_jobs >= 2")


@query("f19_unneeded_edges", f"""
WITH RECURSIVE flow AS ({_FLOW}),
b AS (SELECT e.job, e.dependent_job FROM fx_edges e JOIN fx_jobs x ON x.job = e.job AND x.category = 'MV' JOIN fx_jobs y ON y.job = e.dependent_job AND y.category = 'MV' WHERE EXISTS (SELECT 1 FROM fx_reads r WHERE r.job = e.job)),
c(start, node, hops) AS (SELECT DISTINCT w.tbl, w.tbl, 0 FROM fx_writes w JOIN b ON b.dependent_job = w.job UNION SELECT c.start, f.t, c.hops + 1 FROM c JOIN flow f ON f.s = c.node WHERE c.hops < 4)
SELECT job, dependent_job FROM b WHERE NOT EXISTS (SELECT 1 FROM fx_writes w JOIN c ON c.start = w.tbl JOIN fx_reads r ON r.tbl = c.node WHERE w.job = b.dependent_job AND r.job = b.job)
""")
def f19(fx):
    return detect.unneeded_edges(fx["fx_edges"], fx["fx_jobs"], fx["fx_reads"], fx["fx_writes"])


_IN_PLACE = "SELECT job, tbl FROM fx_reads UNION SELECT job, tbl FROM fx_writes WHERE job % 4 = 0"


@query("f20_update_order", f"""
WITH rd AS ({_IN_PLACE}), u AS (SELECT DISTINCT w.job AS updater, w.tbl FROM fx_writes w JOIN rd r ON r.job = w.job AND r.tbl = w.tbl)
SELECT u.tbl, u.updater, r.job AS reader, CASE WHEN EXISTS (SELECT 1 FROM fx_edges e WHERE e.job = r.job AND e.dependent_job = u.updater) THEN 'UPDATER_FIRST' WHEN EXISTS (SELECT 1 FROM fx_edges e WHERE e.job = u.updater AND e.dependent_job = r.job) THEN 'READER_FIRST' ELSE 'NONE' END AS ordering
FROM u JOIN rd r ON r.tbl = u.tbl WHERE r.job <> u.updater
""")
def f20(fx):
    reads = fx["fx_reads"].unionByName(fx["fx_writes"].where("job % 4 = 0")).distinct()
    return detect.update_order_risks(reads, fx["fx_writes"], fx["fx_edges"])


@query("f21_feedback_loops", f"""
WITH RECURSIVE flow AS ({_FLOW}),
c(start, node, hops) AS (SELECT s, t, 1 FROM flow WHERE s IN (SELECT w.tbl FROM fx_writes w WHERE EXISTS (SELECT 1 FROM fx_reads r WHERE r.job = w.job)) UNION SELECT c.start, f.t, c.hops + 1 FROM c JOIN flow f ON f.s = c.node WHERE c.hops < 8)
SELECT w.job, w.tbl, c.node AS reached, CAST(min(c.hops) AS INTEGER) AS hops FROM fx_writes w JOIN c ON c.start = w.tbl JOIN fx_reads r ON r.job = w.job AND r.tbl = c.node GROUP BY w.job, w.tbl, c.node
""")
def f21(fx):
    return detect.feedback_loops(fx["fx_reads"], fx["fx_writes"])


@query("f23_naming_findings", "SELECT DISTINCT tbl, CASE WHEN ends_with(tbl, '7') THEN 'SUFFIX' ELSE 'PREFIX' END AS kind, concat('INT_', tbl) AS suggestion FROM fx_writes WHERE ends_with(tbl, '7') OR starts_with(tbl, 'TBL_9')")
def f23(fx):
    """Names outside the convention, with a suggestion."""
    odd = fx["fx_writes"].where(F.col("tbl").endswith("7") | F.col("tbl").startswith("TBL_9")).select("tbl").distinct()
    return odd.select("tbl", F.when(F.col("tbl").endswith("7"), "SUFFIX").otherwise("PREFIX").alias("kind"), F.concat(F.lit("INT_"), "tbl").alias("suggestion"))


@query("f10_indicator_walk", """
WITH RECURSIVE c(start, node, hops) AS (SELECT e.dependent_job, e.job, 1 FROM fx_edges e JOIN fx_jobs v ON v.job = e.dependent_job AND v.category = 'MV'
  UNION SELECT c.start, e.job, c.hops + 1 FROM c JOIN fx_edges e ON e.dependent_job = c.node WHERE c.hops < 4)
SELECT start AS view, node AS updater, CAST(min(hops) AS INTEGER) AS hops FROM c JOIN fx_jobs u ON u.job = c.node AND u.is_pass GROUP BY start, node
""")
def f10(fx):
    """Updaters that follow a refreshed view in four steps or fewer."""
    from loomgraph.operators.graph import closure, reversed_edges

    far = closure(reversed_edges(fx["fx_edges"]), fx["fx_jobs"].where("category = 'MV'"), 4)
    return far.join(fx["fx_jobs"].where("is_pass").select(F.col("job").alias("node")), "node", "left_semi").select(F.col("start").alias("view"), F.col("node").alias("updater"), "hops")


@query("f12_finding_jobs", """
WITH f AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN target_table ELSE concat('TBL_', CAST(pos % 45 AS VARCHAR), '_X') END AS script FROM fx_recs),
t AS (SELECT DISTINCT tbl FROM fx_writes)
SELECT f.pos, min(CASE WHEN t.tbl = f.script THEN 0 WHEN contains(f.script, t.tbl) THEN 1 END) AS rank, coalesce(arg_min(t.tbl, CASE WHEN t.tbl = f.script THEN 0 ELSE 1000 - length(t.tbl) END), 'UNMAPPED') AS tbl FROM f LEFT JOIN t ON t.tbl = f.script OR contains(f.script, concat(t.tbl, '_')) GROUP BY f.pos
""")
def f12(fx):
    """The table that a finding's script means: by name, else the longest that begins it; equi-joins on both."""
    script = F.when(F.col("pos") % 3 == 0, F.col("target_table")).otherwise(F.concat(F.lit("TBL_"), (F.col("pos") % 45).cast("string"), F.lit("_X")))
    found = fx["fx_recs"].select("pos", script.alias("script"))
    tables = fx["fx_writes"].select("tbl").distinct()
    parts = F.split("script", "_")
    keys = found.select("pos", F.posexplode(F.array("script", F.concat_ws("_", F.slice(parts, 1, 2)))).alias("rank", "tbl"))
    hits = keys.join(tables, "tbl").groupBy("pos").agg(F.min("rank").alias("rank"), F.min_by("tbl", "rank").alias("tbl"))
    return found.join(hits, "pos", "left").select("pos", "rank", F.coalesce("tbl", F.lit("UNMAPPED")).alias("tbl"))


@query("f12_finding_recommendations", r"""
WITH s AS (SELECT DISTINCT script, upper(replace(replace(script, '.sql', ''), '.txt', '')) AS base FROM fx_findings WHERE pos % 13 <> 0), o AS (SELECT DISTINCT job, name FROM fx_sql_objects),
e AS (SELECT script, job FROM s JOIN o ON name = base), p AS (SELECT DISTINCT script, job FROM s JOIN o ON contains(name, base) OR contains(base, name) WHERE script NOT IN (SELECT script FROM e)),
t AS (SELECT tbl, min(job) AS pos FROM fx_writes GROUP BY tbl), m AS (SELECT script, arg_min(tbl, pos) AS tbl FROM s JOIN t ON contains(base, tbl) WHERE script NOT IN (SELECT script FROM e) AND script NOT IN (SELECT script FROM p) GROUP BY script),
j AS (SELECT script, 'EXACT' AS how, job FROM e UNION ALL SELECT script, 'PARTIAL', job FROM p UNION ALL SELECT script, 'TARGET', w.job FROM m JOIN fx_writes w ON w.tbl = m.tbl),
k AS (SELECT script, min(how) AS how, string_agg(DISTINCT lpad(CAST(job AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(job AS VARCHAR), 9, '0')) AS jobs FROM j GROUP BY script),
c AS (SELECT script, CASE WHEN regexp_matches(lower(finding), 'redundant|duplicate|repeated|unnecessary|remove') THEN 1 WHEN regexp_matches(lower(finding), 'bug|error|incorrect|wrong|missing|mismatch') THEN 2 WHEN regexp_matches(lower(finding), 'performance|slow|full scan|index|parallel|bulk') THEN 3 ELSE 4 END AS k FROM fx_findings),
n AS (SELECT script, count(*) AS n_findings, count(*) FILTER (k = 1) AS n_redundancy, count(*) FILTER (k = 2) AS n_logic, count(*) FILTER (k = 3) AS n_performance, count(*) FILTER (k = 4) AS n_other FROM c GROUP BY script)
SELECT n.*, coalesce(how, 'UNMAPPED') AS how, coalesce(jobs, 'UNMAPPED') AS jobs, CASE WHEN n_logic > 2 THEN 'HIGH' WHEN n_performance > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, n_redundancy AS savings,
concat('Script ''', n.script, ''' has ', n_findings, ' findings: ', array_to_string(list_filter([CASE WHEN n_redundancy > 0 THEN concat(n_redundancy, ' redundancy signals') END, CASE WHEN n_logic > 0 THEN concat(n_logic, ' logic risks') END, CASE WHEN n_performance > 0 THEN concat(n_performance, ' perf concerns') END, CASE WHEN n_other > 0 THEN concat(n_other, ' other findings') END], lambda x: x IS NOT NULL), ', '), '.') AS description,
concat('Review script for optimization opportunities. Top concern: ', CASE WHEN n_redundancy > 0 THEN 'redundancy removal' WHEN n_performance > 0 THEN 'performance tuning' WHEN n_logic > 0 THEN 'bug fixes' ELSE 'general cleanup' END, '.') AS recommendation
FROM n LEFT JOIN k ON k.script = n.script
""")
def f12_recommendations(fx):
    """Findings by script with the jobs that the script means; scripts without a summary are known by no name."""
    from loomgraph.operators.matching import finding_recommendations

    targets = fx["fx_writes"].select("job", "tbl", F.col("job").alias("pos"))
    return finding_recommendations(fx["fx_findings"], fx["fx_findings"].where("pos % 13 <> 0").select("script"), fx["fx_sql_objects"], targets)


@query("f24_misnamed_views", r"""
WITH v AS (SELECT DISTINCT upper(view) AS view FROM fx_view_names WHERE ends_with(upper(view), '_VW') AND NOT starts_with(upper(view), 'VW_')),
l AS (SELECT upper(src_table) AS t, trim(package) AS name FROM fx_view_rows UNION SELECT upper(src_table), trim(object) FROM fx_view_rows),
a AS (SELECT view, CASE WHEN contains(name, '.') THEN name ELSE concat(name, '.sql') END AS script FROM v JOIN l ON contains(t, view) WHERE name <> '' AND NOT starts_with(upper(name), 'VIEW_') AND name <> view),
j AS (SELECT script, CAST(summary AS JSON)->'INPUT_DEPENDENCIES' AS d FROM fx_dependencies),
g AS (SELECT script, d->'source_tables' AS o FROM j UNION ALL SELECT script, d->'procedure_level_dependencies' FROM j),
x AS (SELECT script, o->k AS e FROM (SELECT script, o, unnest(json_keys(o)) AS k FROM g WHERE json_type(o) = 'OBJECT')),
y AS (SELECT script, unnest(CAST(e AS JSON[])) AS s FROM x WHERE json_type(e) = 'ARRAY'),
b AS (SELECT view, script FROM v JOIN y ON contains(upper(s->>'$'), view) WHERE upper(script) <> concat(view, '.SQL')),
u AS (SELECT view, script FROM a UNION SELECT view, script FROM b)
SELECT v.view, concat('VW_', ltrim(replace(v.view, '_VW', ''), '_')) AS suggestion, coalesce(string_agg(script, ',' ORDER BY script), '') AS scripts, count(script) AS n_scripts FROM v LEFT JOIN u ON u.view = v.view GROUP BY v.view
""")
def f24_misnamed(fx):
    """Views named by a suffix, what they should be called, and the scripts that mention them."""
    from loomgraph.operators.matching import misnamed_views

    return misnamed_views(fx["fx_view_names"], fx["fx_view_rows"], fx["fx_dependencies"])


@query("f22_updater_loops", f"""
WITH RECURSIVE rd AS ({_IN_PLACE}), flow AS (SELECT DISTINCT r.tbl AS s, w.tbl AS t FROM rd r JOIN fx_writes w ON r.job = w.job WHERE r.tbl <> w.tbl),
u AS (SELECT w.job, w.tbl FROM fx_writes w JOIN rd r ON r.job = w.job AND r.tbl = w.tbl),
c(start, node, hops) AS (SELECT s, t, 1 FROM flow WHERE s IN (SELECT tbl FROM u) UNION SELECT c.start, f.t, c.hops + 1 FROM c JOIN flow f ON f.s = c.node WHERE c.hops < 8)
SELECT u.job, u.tbl, count(DISTINCT c.node) AS n_downstream FROM u JOIN c ON c.start = u.tbl GROUP BY u.job, u.tbl
""")
def f22(fx):
    """How much lies downstream of the tables that jobs update in place."""
    from loomgraph.operators.graph import closure

    reads = fx["fx_reads"].unionByName(fx["fx_writes"].where("job % 4 = 0")).distinct()
    updaters = detect.updates_in_place(reads, fx["fx_writes"])
    flow = reads.toDF("job", "s").join(fx["fx_writes"].toDF("job", "t"), "job").where("s <> t").select(F.col("s").alias("job"), F.col("t").alias("dependent_job")).distinct()
    far = closure(flow, updaters.select(F.col("tbl").alias("job")), 8)
    return updaters.join(far.select(F.col("start").alias("tbl"), "node"), "tbl").groupBy("job", "tbl").agg(F.count_distinct("node").alias("n_downstream"))


@query("f24_view_names", "SELECT DISTINCT concat(tbl, CASE WHEN job % 2 = 0 THEN '_VW' ELSE '' END) AS name FROM fx_writes WHERE job % 2 = 0 AND NOT starts_with(tbl, 'VW_')")
def f24(fx):
    """Views named by a suffix instead of the prefix."""
    name = F.concat("tbl", F.when(F.col("job") % 2 == 0, "_VW").otherwise(""))
    return fx["fx_writes"].select(name.alias("name")).where(F.col("name").endswith("_VW") & ~F.col("name").startswith("VW_")).distinct()


@query("f25_temporary_tables", "SELECT concat(tbl, '_GTT') AS name, count(DISTINCT job) AS n_writers FROM fx_writes WHERE job % 6 = 1 GROUP BY tbl")
def f25(fx):
    """Temporary tables with a local writer."""
    named = fx["fx_writes"].select("job", F.concat("tbl", F.when(F.col("job") % 6 == 1, "_GTT").otherwise("")).alias("name"))
    return named.where(F.col("name").endswith("_GTT")).groupBy("name").agg(F.count_distinct("job").alias("n_writers"))


@query("f26_bulk_updates", "SELECT p_partkey AS package, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_loops FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0")
def f26(fx):
    """Packages that collect in bulk and update in loops, and how many loops."""
    text = F.concat(F.lit("BULK COLLECT; "), F.when(F.col("p_size") % 2 == 0, "FORALL i IN 1..n UPDATE t SET a = 1; ").otherwise(""), F.when(F.col("p_size") % 3 == 0, "FORALL j IN v UPDATE u SET b = 2;").otherwise("INSERT;"))
    rows = fx["part"].select(F.col("p_partkey").alias("package"), text.alias("body")).where(F.col("body").rlike("BULK COLLECT") & F.col("body").rlike("FORALL") & F.col("body").rlike("UPDATE"))
    return rows.select("package", F.regexp_count("body", F.lit(r"FORALL[^;]{0,50}?UPDATE")).alias("n_loops"))


@query("f27_hard_coded_mappings", "SELECT p_partkey AS package, p_size % 7 AS n_values, CASE WHEN p_size % 7 >= 5 THEN 'LOOKUP' ELSE 'CASE' END AS kind FROM part WHERE p_size % 7 >= 4")
def f27(fx):
    """Mappings with four quoted values or more."""
    text = F.concat_ws(" ", F.transform(F.expr("sequence(0, p_size % 7)"), lambda i: F.when(i > 0, F.concat(F.lit("WHEN 'V"), i.cast("string"), F.lit("'"))).otherwise("CASE")))
    rows = fx["part"].select(F.col("p_partkey").alias("package"), F.regexp_count(text, F.lit("'[^']*'")).alias("n_values"))
    return rows.where("n_values >= 4").select("package", "n_values", F.when(F.col("n_values") >= 5, "LOOKUP").otherwise("CASE").alias("kind"))


@query("f15_cycles", """
WITH RECURSIVE c(a, b) AS (SELECT job, dependent_job FROM fx_cyclic UNION SELECT c.a, e.dependent_job FROM c JOIN fx_cyclic e ON e.job = c.b),
s AS (SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT component, count(*) AS n_jobs FROM s GROUP BY component
""")
def f15(fx):
    """Cycles of dependencies, by their sizes."""
    from loomgraph.operators.graph import strong_components

    return strong_components(fx["fx_cyclic"]).groupBy("component").agg(F.count(F.lit(1)).alias("n_jobs"))


_ANY = lambda words, text: "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_ODD_IN = "(" + " OR ".join([f"ends_with(up, '{x}')" for x in detect.INTERMEDIATE_SUFFIXES] + [f"contains(up, '{x}')" for x in detect.INTERMEDIATE_PARTS]) + ")"


@query("f23_intermediate_names", f"""
WITH rp AS (SELECT concat('RPT_', CAST(job % 4 AS VARCHAR)) AS rpt, job FROM fx_jobs WHERE job % 5 <> 0),
u AS (SELECT tbl, job, max(w) AS w, min(w) AS r FROM (SELECT job, tbl, 1 AS w FROM fx_named_writes UNION ALL SELECT job, tbl, 0 FROM fx_named_reads) GROUP BY tbl, job),
o AS (SELECT *, upper(tbl) AS up FROM u), k AS (SELECT *, CASE WHEN {_ODD_IN} THEN 'INTERMEDIATE' ELSE 'HYBRID' END AS kind FROM o
  WHERE ({_ODD_IN} OR starts_with(up, 'FCT_RPT_')) AND NOT ends_with(up, '_EXG') AND NOT contains(up, ',') AND NOT {_ANY(detect.LOG_PARTS, 'up')} AND NOT regexp_matches(up, '^(PRCS_JOB_LOG_|PRCS_GRP_TBL_|SSL_PACKAGE_)') AND NOT regexp_matches(up, '^(TAB[0-9]*|T[0-9]+|[A-Z][0-9]*|[A-Z]{{1,3}})$')),
l AS (SELECT rpt, tbl, up, kind, count(*) FILTER (WHERE w = 1) AS n_writers, count(*) FILTER (WHERE r = 0) AS n_readers FROM k JOIN rp USING (job) GROUP BY ALL HAVING count(*) FILTER (WHERE w = 1) > 0),
t AS (SELECT tbl, count(DISTINCT k.job) AS n_jobs, count(DISTINCT rpt) AS n_rpts FROM k LEFT JOIN rp USING (job) GROUP BY tbl)
SELECT rpt, tbl, kind, CASE WHEN kind = 'HYBRID' THEN concat('STG_', substr(up, 9)) WHEN starts_with(up, 'STG_') THEN up ELSE concat('STG_', up) END AS suggestion, n_writers, n_readers, n_rpts, least(n_jobs + n_rpts - 1, 10) AS blast, CASE WHEN n_rpts > 1 THEN 'EXECUTE_GLOBAL_PROGRAM' ELSE 'EXECUTE_LOCALLY' END AS decision FROM l JOIN t USING (tbl)
""")
def f23_names(fx):
    """Intermediate and hybrid names with what a change of them touches."""
    reports = fx["fx_jobs"].where("job % 5 <> 0").select(F.concat(F.lit("RPT_"), (F.col("job") % 4).cast("string")).alias("rpt"), "job")
    return detect.intermediate_names(fx["fx_named_writes"], fx["fx_named_reads"], reports)


@query("f26_bulk_passes", r"""
WITH s AS (SELECT package, concat(CAST(json_extract_string(summary, '$.PROCESS_FLOW.Cursor_use') AS VARCHAR), ' ', coalesce(json_extract_string(summary, '$.PROCESS_FLOW.bulk'), '')) AS t FROM fx_summaries)
SELECT package, CAST(greatest(1, len(regexp_extract_all(t, '(?i)OPEN\s+\w+|CURSOR\s+\w+\s+IS'))) AS INTEGER) AS n_cursors, CAST(greatest(1, len(regexp_extract_all(t, '(?is)FORALL.{1,50}UPDATE'))) AS INTEGER) AS n_updates
FROM s WHERE contains(upper(t), 'BULK COLLECT') AND contains(upper(t), 'FORALL') AND contains(upper(t), 'UPDATE')
""")
def f26_passes(fx):
    """Bulk updates by what summaries say of cursors and bulk work."""
    return summaries.bulk_passes(_summaries(fx))


def _summaries(fx):
    return fx["fx_summaries"]


@query("f27_logic_entries", f"""
WITH j AS (SELECT package, json_extract(summary, '$.TRANSFORMATION_SUMMARY.hardcoded_logic') AS l FROM fx_summaries),
e AS (SELECT package, i - 1 AS at_place, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, concat('$[', CAST(i - 1 AS VARCHAR), ']')) ELSE l END AS e FROM j, LATERAL (SELECT unnest(range(1, CAST(CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l) ELSE 1 END AS BIGINT) + 1)) AS i) x),
t AS (SELECT package, at_place, json_type(e) = 'OBJECT' AS is_object, CASE WHEN json_type(e) = 'OBJECT' THEN NULL ELSE json_extract_string(e, '$') END AS text, CAST(json_extract(e, '$.approx_branch_count') AS DOUBLE) AS branches FROM e),
c AS (SELECT *, lower(text) AS low, len(list_filter(regexp_extract_all(text, '''([^'']{{1,40}})''', 1), lambda v: trim(v) <> '' AND v NOT IN ('Y', 'N', '1', '0'))) AS n FROM t),
o AS (SELECT *, {_ANY(summaries.OPERATIONAL, 'low')} AS op FROM c)
SELECT package, CAST(at_place AS INTEGER) AS at, CASE WHEN is_object THEN 'VALUE_MAPPING' WHEN op AND {_ANY(summaries.DEFAULTS, 'low')} THEN 'DEFAULT_VALUE' WHEN op THEN 'CONSTANT_FILTER' WHEN {_ANY(summaries.MAPPINGS, 'low')} THEN 'VALUE_MAPPING' WHEN {_ANY(summaries.EXCLUSIONS, 'low')} THEN 'EXCLUSION_LIST' WHEN {_ANY(summaries.FILTERS, 'low')} THEN 'CONSTANT_FILTER' ELSE 'INLINE_LOGIC' END AS kind,
  CAST(CASE WHEN is_object THEN 0 ELSE n END AS INTEGER) AS n_values, CASE WHEN is_object THEN branches >= 5 ELSE ({_ANY(summaries.SUBSTANTIAL, 'low')} OR n >= 4) AND NOT op END AS substantial FROM o
""")
def f27_entries(fx):
    """Entries on hard-coded logic by kind, and whether they are worth a table."""
    return summaries.logic_entries(_summaries(fx))


@query("f27_hard_coded")
def f27_packages(fx):
    """Packages with a mapping or an exclusion that is worth a table."""
    return summaries.hard_coded(_summaries(fx))


#: The detectors in their order: letter, query and the column that names what a finding is about.
DETECTORS = (
    ("A", "f01_multi_source_loads", "tbl"), ("B1", "f02_updates_in_place", "tbl"), ("B2", "f03_pass_through", "tbl"), ("C", "f04_similar_sets", "tgt_table"), ("D", "f05_serial_chains", "first"),
    ("E1", "f06_view_consumers", "mv"), ("E2", "f07_single_consumer_views", "mv"), ("E3", "f08_unread_with_updater", "mv"), ("E4", "f09_dead_views", "tbl"), ("E5", "f10_indicator_walk", "view"), ("E-IC", "f11_indicator_chains", "job"),
    ("F", "f12_finding_jobs", "tbl"), ("G", "f13_duplicated_flows", "tgt_table"), ("H", "f14_unused_intermediates", "tbl"), ("I", "f15_cycles", "component"), ("J", "f16_wide_views", "mv"), ("K", "f17_identical_mappings", "tgt_table"),
    ("L", "f18_staging_names", "tbl"), ("M", "f19_unneeded_edges", "job"), ("N", "f20_update_order", "tbl"), ("N-CL", "f21_feedback_loops", "tbl"), ("N-PL", "f22_updater_loops", "tbl"),
    ("O-a", "f23_intermediate_names", "tbl"), ("O-b", "f24_view_names", "name"), ("O-d", "f25_temporary_tables", "name"), ("P", "f26_bulk_passes", "package"), ("Q", "f27_logic_entries", "package"),
)


@query("f28_all_findings", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS place, '{letter}' AS detector, CAST({about} AS VARCHAR) AS about, count(*) AS n FROM ({registry.ORACLES[name]}) GROUP BY ALL" for i, (letter, name, about) in enumerate(DETECTORS)
))
def f28(fx):
    """All detectors in their order, under one schema: what a finding is about, and how many there are.

    Each detector's counts are written before the next one is planned. The driver holds the plan of one of them at a time,
    with all the versions that adaptive execution reports of it; in one plan these outgrow it.
    """
    found = None
    for i, (letter, name, about) in enumerate(DETECTORS):
        one = registry.DEFINED[name](fx).groupBy(F.col(about).cast("string").alias("about")).agg(F.count(F.lit(1)).alias("n"))
        one = materialize(one.select(F.lit(i).alias("place"), F.lit(letter).alias("detector"), "about", "n"), f"finding-{i}")
        found = one if found is None else found.unionByName(one)
    return found


_LOG = "regexp_matches(upper(tbl), '_DEBUG_TRC|_TRC|EXEC_STATUS_LOG|PROC_EXEC_STATUS|_JOB_LOG|PRCS_JOB_LOG|JOB_LOG_MESSAGE|_AUDIT_LOG|AUDIT_LOG|LOG_TABLE|PRCS_GRP_TBL_LOAD_DEBUG|MILESTONE_TABLE|_MILESTONE_')"
_CHAIN_EDGES = "SELECT job, job + 1 AS dependent_job FROM fx_jobs WHERE job % 7 <> 0 UNION SELECT job, dependent_job FROM fx_edges WHERE job % 7 = 0"


@query("f01_load_recommendations", f"""
WITH l AS (SELECT * FROM fx_loads WHERE NOT is_view AND NOT {_LOG}), s AS (SELECT tbl FROM l GROUP BY tbl HAVING count(DISTINCT job) >= 2 AND NOT bool_and(contains(upper(coalesce(params, '')), 'MULTI_SRC'))),
j AS (SELECT DISTINCT tbl, job FROM l WHERE tbl IN (SELECT tbl FROM s)), m AS (SELECT tbl, j.job, CASE WHEN contains(job, '_CV_') THEN 'CV' WHEN contains(job, '_PACS_') THEN 'PACS' END AS system FROM j),
g AS (SELECT tbl, count(*) AS n, string_agg(job, ',' ORDER BY job) AS jobs, count(DISTINCT system) AS n_systems FROM m GROUP BY tbl),
o AS (SELECT j.tbl, count(DISTINCT object) AS n_objects, count(DISTINCT string_split(object, '.')[1]) AS n_packages, bool_and(coalesce(is_parameterised, false)) AS given FROM j LEFT JOIN fx_load_objects x ON x.job = j.job GROUP BY j.tbl),
c AS (SELECT g.*, CASE WHEN n_objects = 1 AND given THEN 'ALREADY_PARAMETERIZED' WHEN n_packages = 1 AND n_objects > 1 THEN 'SAME_PKG_VARIANT' ELSE 'DIFF_SQL_OBJECTS' END AS scope, n_packages FROM g JOIN o ON o.tbl = g.tbl),
k AS (SELECT *, CASE WHEN n_systems >= 2 AND (scope = 'ALREADY_PARAMETERIZED' OR scope = 'SAME_PKG_VARIANT' OR n_packages <= 1) THEN 1 WHEN scope = 'ALREADY_PARAMETERIZED' THEN 2 ELSE 3 END AS kind FROM c)
SELECT CASE kind WHEN 1 THEN 'A. Source System Architectural Split (By Design)' WHEN 2 THEN 'A. Already Parameterized (No Action Needed)' ELSE 'A. Redundant Multi-Source Load' END AS category, tbl AS target_table, jobs AS affected_jobs, n AS current_hops,
  CASE WHEN kind = 3 THEN n - 1 ELSE 0 END AS savings, CASE WHEN kind = 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN kind = 1 THEN 'SOURCE_SYSTEM_SPLIT' ELSE scope END AS scope FROM k
""")
def f01_recommendations(fx):
    """What to do about targets with several loads: kept apart on purpose, settled, or to be put together."""
    from loomgraph.operators.recommendations import load_recommendations

    return load_recommendations(fx["fx_loads"], fx["fx_load_objects"]).drop("description", "recommendation")


@query("f02_update_recommendations", f"SELECT string_agg(tbl, ', ' ORDER BY tbl) AS target_table, CAST(job AS VARCHAR) AS affected_jobs, 'MEDIUM' AS risk FROM (SELECT DISTINCT job, tbl FROM fx_named_in_place) WHERE NOT {_LOG} AND NOT starts_with(upper(tbl), 'RPT_') AND NOT ends_with(upper(tbl), '_GTT') GROUP BY job")
def f02_recommendations(fx):
    """Jobs that update a table in place, but for log, report and temporary tables."""
    from loomgraph.operators.recommendations import update_recommendations

    return update_recommendations(fx["fx_named_in_place"], fx["fx_named_in_place"]).select("target_table", "affected_jobs", "risk")


def chain_relations(fx) -> dict:
    """Edges, jobs and written columns of the chain detector."""
    jobs = fx["fx_jobs"]
    edges = jobs.where("job % 7 <> 0").select("job", (F.col("job") + 1).alias("dependent_job")).union(fx["fx_edges"].where("job % 7 = 0")).distinct()
    kinds = jobs.select("job", F.when(F.col("job") % 3 == 0, "FCT").otherwise("OTHER").alias("category"), (F.col("job") % 11).alias("depth"), (F.col("job") % 13 == 0).alias("has_object"))
    writes = fx["fx_writes"].select("job", "tbl", F.concat(F.lit("C"), (F.col("job") % 2).cast("string")).alias("col")).union(jobs.where("job % 17 < 3").select("job", F.lit("SHARED"), F.lit("K")))
    return {"edges": edges, "jobs": kinds, "writes": writes}


def view_relations(fx) -> dict:
    """Views, tables and columns of the view detector."""
    numbered = lambda df, most: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("col", F.concat(F.lit("C"), F.col("i").cast("string")))
    written = numbered(fx["fx_writes"], 5).where("i <= job % 6").select("job", "tbl", "col")
    consumed = numbered(fx["fx_reads"], 2).where("i < job % 4").select("job", "tbl", "col")
    return {"views": fx["fx_jobs"].where("category = 'MV'").select("job"), "reads": fx["fx_reads"], "writes": fx["fx_writes"], "written": written, "consumed": consumed}


@query("f05_chain_recommendations", f"""
WITH RECURSIVE e AS ({_CHAIN_EDGES}), p AS (SELECT job, job % 11 AS depth FROM fx_jobs WHERE job % 3 <> 0 AND job % 13 <> 0 AND job % 11 >= 3),
i AS (SELECT e.job, e.dependent_job FROM e WHERE e.job IN (SELECT job FROM p) AND e.dependent_job IN (SELECT job FROM p)),
l AS (SELECT * FROM i WHERE job IN (SELECT job FROM i GROUP BY job HAVING count(*) = 1) AND dependent_job IN (SELECT dependent_job FROM i GROUP BY dependent_job HAVING count(*) = 1)),
c(first, job, step) AS (SELECT job, job, 0 FROM l WHERE job NOT IN (SELECT dependent_job FROM l) UNION ALL SELECT c.first, l.dependent_job, c.step + 1 FROM c JOIN l ON l.job = c.job),
w AS (SELECT job, tbl, concat('C', CAST(job % 2 AS VARCHAR)) AS col FROM fx_writes UNION SELECT job, 'SHARED', 'K' FROM fx_jobs WHERE job % 17 < 3),
d AS (SELECT DISTINCT a.first FROM c a JOIN c b ON b.first = a.first AND b.step = a.step + 1 JOIN w x ON x.job = a.job JOIN w y ON y.job = b.job AND y.tbl = x.tbl AND y.col = x.col)
SELECT string_agg(CAST(c.job AS VARCHAR), ',' ORDER BY step) AS affected_jobs, count(*) AS current_hops, max(depth) - min(depth) AS savings FROM c JOIN p ON p.job = c.job WHERE first NOT IN (SELECT first FROM d) GROUP BY first HAVING count(*) >= 2
""")
def f05_recommendations(fx):
    """Chains of deep jobs without objects that hand over no data."""
    from loomgraph.operators.recommendations import chain_recommendations

    return chain_recommendations(**chain_relations(fx)).select("affected_jobs", "current_hops", "savings")


@query("f07_view_recommendations", """
WITH v AS (SELECT job FROM fx_jobs WHERE category = 'MV'), o AS (SELECT DISTINCT w.job AS mv, w.tbl FROM fx_writes w JOIN v ON v.job = w.job), u AS (SELECT DISTINCT o.mv, r.job FROM o JOIN fx_reads r ON r.tbl = o.tbl WHERE r.job <> o.mv),
s AS (SELECT mv, min(job) AS consumer FROM u GROUP BY mv HAVING count(*) = 1), n AS (SELECT job, count(DISTINCT tbl) AS n FROM fx_reads GROUP BY job),
w AS (SELECT job, concat('C', CAST(i AS VARCHAR)) AS col FROM fx_writes, (SELECT unnest(range(0, 6)) AS i) WHERE i <= job % 6), t AS (SELECT job, tbl, concat('C', CAST(i AS VARCHAR)) AS col FROM fx_reads, (SELECT unnest(range(0, 3)) AS i) WHERE i < job % 4),
k AS (SELECT s.mv, count(DISTINCT w.col) AS n_columns FROM s JOIN w ON w.job = s.mv GROUP BY s.mv), r AS (SELECT s.mv, count(DISTINCT t.col) AS n_read FROM s JOIN o ON o.mv = s.mv JOIN t ON t.job = s.consumer AND t.tbl = o.tbl GROUP BY s.mv),
b AS (SELECT s.mv, count(DISTINCT t.col) AS n_taken FROM s JOIN o ON o.mv = s.mv JOIN t ON t.job = s.consumer AND t.tbl = o.tbl JOIN w ON w.job = s.mv AND w.col = t.col GROUP BY s.mv)
SELECT concat(CAST(s.mv AS VARCHAR), ',', CAST(consumer AS VARCHAR)) AS affected_jobs, CASE WHEN coalesce(n.n, 0) >= 4 THEN 'HIGH' WHEN coalesce(n_read, 0) > 0 AND 2 * coalesce(n_taken, 0) < n_columns THEN 'MEDIUM' ELSE 'HIGH' END AS risk
FROM s LEFT JOIN n ON n.job = s.mv LEFT JOIN k ON k.mv = s.mv LEFT JOIN r ON r.mv = s.mv LEFT JOIN b ON b.mv = s.mv
""")
def f07_recommendations(fx):
    """Views with one consumer and the risk of inlining them, by the share of columns used and the tables read."""
    from loomgraph.operators.recommendations import view_recommendations

    return view_recommendations(**view_relations(fx)).select("affected_jobs", "risk")


def detector_context(fx) -> dict:
    """The relations that the registered detectors ask for."""
    summaries_known = fx["fx_findings"].where("pos % 13 <> 0").select("script")
    jobs, chain, view = fx["fx_wide_lineage"].select("job").distinct(), chain_relations(fx), view_relations(fx)
    return {
        **{f"chain_{k}": v for k, v in chain.items()}, "mv_jobs": view.pop("views"), **view,
        "lineage": fx["fx_wide_lineage"], "offset_jobs": jobs.where("job % 40 = 0"), "parameterised": jobs.where("job % 3 = 0"),
        "findings": fx["fx_findings"], "scripts": summaries_known, "sql_objects": fx["fx_sql_objects"], "targets": fx["fx_writes"].select("job", "tbl", F.col("job").alias("pos")),
        "views": fx["fx_view_names"], "view_rows": fx["fx_view_rows"], "dependencies": fx["fx_dependencies"],
        "loads": fx["fx_loads"], "objects": fx["fx_load_objects"], "in_place_reads": fx["fx_named_in_place"], "in_place_writes": fx["fx_named_in_place"],
    }


@query("f28_recommendations")
def f28_recommendations(fx):
    """The recommendations of all registered detectors, each run on its own."""
    from loomgraph.operators.detectors import DETECTORS as registered

    return registered.run(fx.spark, detector_context(fx))[0]
