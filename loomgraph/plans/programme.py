"""Scoring, simulation and roll-up queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import joined
from loomgraph.operators import graph, programme

from .graphs import _DEPTH
from .registry import query

_KEY = "concat(CAST(least(job_a, job_b) AS VARCHAR), CASE WHEN job_a = job_b THEN '' ELSE concat(',', CAST(greatest(job_a, job_b) AS VARCHAR)) END)"
_POLICY = "CASE WHEN substr(category, 1, 2) IN ('B.', 'D.', 'F.') THEN 'EXECUTE_LOCALLY' WHEN contains(category, 'Duplicate') THEN 'DEFER_OR_KEEP' ELSE 'EXECUTE_GLOBAL_PROGRAM' END"
_RANK = "CASE risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


def recs(fx):
    jobs = F.array_sort(F.array_distinct(F.array("job_a", "job_b")))
    found = fx["fx_recs"].withColumn("jobs", jobs)
    return found.withColumn("job_key", F.array_join(F.transform("jobs", lambda j: j.cast("string")), ","))


@query("h01_metric_kinds", "SELECT pos, CASE WHEN starts_with(category, 'F.') THEN 0 ELSE hops END AS verified_hops, CASE WHEN starts_with(category, 'F.') THEN 'SUGGESTED' ELSE 'VERIFIED' END AS evidence FROM fx_recs")
def h01(fx):
    """Suggested findings never count savings."""
    suggested = F.col("category").startswith("F.")
    return fx["fx_recs"].select("pos", F.when(suggested, 0).otherwise(F.col("hops")).alias("verified_hops"), F.when(suggested, "SUGGESTED").otherwise("VERIFIED").alias("evidence"))


@query("h02_merged_findings", f"""
WITH r AS (SELECT *, substr(category, 1, 2) AS family, {_KEY} AS job_key FROM fx_recs)
SELECT rpt, family, job_key, target_table, min(pos) AS pos, arg_min(category, pos) AS category, max(hops) AS hops, CASE max({_RANK}) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, max(est_min) AS est_min, count(*) AS n_merged
FROM r GROUP BY rpt, family, job_key, target_table
""")
def h02(fx):
    return programme.merged_findings(recs(fx))


@query("h03_objects", """
WITH o AS (SELECT pos, job_a AS job FROM fx_recs UNION SELECT pos, job_b FROM fx_recs)
SELECT pos, coalesce(string_agg(DISTINCT sql_object, ',' ORDER BY sql_object), '') AS objects FROM o LEFT JOIN fx_jobs USING (job) GROUP BY pos
""")
def h03(fx):
    """The SQL objects of a finding's jobs."""
    each = recs(fx).select("pos", F.explode("jobs").alias("job"))
    return each.join(fx["fx_jobs"].select("job", "sql_object"), "job", "left").groupBy("pos").agg(joined(F.collect_set("sql_object")).alias("objects"))


@query("h05_runtime_estimates", """
WITH j AS (SELECT pos, category, hops, job_a AS job FROM fx_recs UNION SELECT pos, category, hops, job_b FROM fx_recs),
t AS (SELECT pos, j.category, hops, runtime_sec, row_number() OVER (PARTITION BY pos ORDER BY runtime_sec) AS r FROM j JOIN fx_jobs n ON n.job = j.job)
SELECT pos, round(CASE WHEN starts_with(min(category), 'F.') THEN 0 WHEN starts_with(min(category), 'D.') THEN sum(runtime_sec) - max(runtime_sec) ELSE coalesce(sum(runtime_sec) FILTER (WHERE r <= hops), 0) END, 1) AS seconds FROM t GROUP BY pos
""")
def h05(fx):
    """Runtime that each finding saves."""
    each = recs(fx).select("pos", "category", "hops", F.explode("jobs").alias("job")).join(fx["fx_jobs"].select("job", "runtime_sec"), "job")
    by = each.groupBy("pos", "category", "hops").agg(F.collect_list("runtime_sec").alias("r"))
    return by.select("pos", F.round(programme.runtime_estimate(F.col("category"), F.col("r"), F.col("hops")), 1).alias("seconds"))


@query("h06_policy", f"SELECT {_POLICY} AS decision, CASE WHEN {_POLICY} = 'EXECUTE_GLOBAL_PROGRAM' THEN CASE risk WHEN 'LOW' THEN 'WAVE_1' WHEN 'MEDIUM' THEN 'WAVE_2' ELSE 'WAVE_3' END ELSE 'NONE' END AS wave, count(*) AS n FROM fx_recs GROUP BY 1, 2")
def h06(fx):
    """Decision and wave of the findings."""
    decision = programme.policy(F.col("category"))
    wave = F.when(F.col("risk") == "LOW", "WAVE_1").when(F.col("risk") == "MEDIUM", "WAVE_2").otherwise("WAVE_3")
    marked = fx["fx_recs"].withColumn("decision", decision)
    return marked.groupBy("decision", F.when(F.col("decision") == "EXECUTE_GLOBAL_PROGRAM", wave).otherwise("NONE").alias("wave")).agg(F.count(F.lit(1)).alias("n"))


@query("h07_supporting_evidence", """
WITH j AS (SELECT pos, category, rpt, job_a AS job FROM fx_recs UNION SELECT pos, category, rpt, job_b FROM fx_recs)
SELECT a.pos, count(DISTINCT b.pos) AS n_supporting FROM j a JOIN j b ON a.rpt = b.rpt AND a.job = b.job WHERE NOT starts_with(a.category, 'F.') AND starts_with(b.category, 'F.') GROUP BY a.pos
""")
def h07(fx):
    """How many suggested findings share a job with a verified one.

    Findings have one or two jobs, so those with either are those with the one, and with the other, less those with both:
    suggested findings are counted by job and by pair of jobs, and never stand beside each verified one.
    """
    jobs = F.array_sort("jobs")
    some = F.when(F.size("jobs") == 2, F.array(F.array(jobs[0]), F.array(jobs[1]), jobs)).otherwise(F.array(jobs))
    each = recs(fx).select("pos", F.col("category").startswith("F.").alias("soft"), "rpt", F.explode(some).alias("held"))
    soft = each.where("soft").groupBy("rpt", "held").agg(F.count(F.lit(1)).alias("n"))
    sign = F.when(F.size("held") == 2, -1).otherwise(1)
    return each.where("not soft").join(soft, ["rpt", "held"]).groupBy("pos").agg(F.sum(F.col("n") * sign).alias("n_supporting"))


_POINTS = "CASE " + " ".join(f"WHEN contains(category, '{t}') THEN {n}" for t, n in programme.CATEGORY_POINTS) + " ELSE 10 END"


@query("h08_scores", f"""
WITH RECURSIVE d AS ({_DEPTH.format(frm="job", to="dependent_job", more="").strip()}),
j AS (SELECT node AS job, min(depth) / (SELECT max(depth) FROM d) AS share FROM d GROUP BY node),
r AS (SELECT *, {_KEY} AS job_key FROM fx_recs), m AS (SELECT rpt, substr(category, 1, 2) AS family, job_key, target_table, count(*) AS n_merged FROM r GROUP BY ALL),
g AS (SELECT target_table, job_key, count(DISTINCT rpt) AS n_rpts, sum(est_min) AS global_min FROM r GROUP BY ALL)
SELECT r.pos, CAST(greatest(0, {_POINTS} + least(12 * hops, 40) + CASE risk WHEN 'LOW' THEN 25 WHEN 'HIGH' THEN 5 ELSE 15 END + coalesce(floor(15 * greatest(a.share, b.share)), 0) + CASE WHEN job_a = job_b THEN 1 ELSE 2 END
  + CASE WHEN starts_with(category, 'F.') THEN least((r.pos % 60) // 5, 8) - CASE WHEN r.pos % 8 = 0 THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN n_merged > 1 THEN 10 ELSE 0 END + least(floor(est_min / 5), 20)
  + least(floor(greatest(global_min - est_min, 0) / 5), 15) + least(greatest(n_rpts - 1, 0) * 2, 10) + CASE {_POLICY} WHEN 'EXECUTE_GLOBAL_PROGRAM' THEN 6 WHEN 'DEFER_OR_KEEP' THEN -4 ELSE 0 END) AS BIGINT) AS score
FROM r JOIN m ON m.rpt = r.rpt AND m.family = substr(r.category, 1, 2) AND m.job_key = r.job_key AND m.target_table = r.target_table JOIN g ON g.target_table = r.target_table AND g.job_key = r.job_key LEFT JOIN j a ON a.job = job_a LEFT JOIN j b ON b.job = job_b
""")
def h08(fx):
    """Points by category, savings, risk, depth, jobs, signals, merged findings, minutes and reach over reports."""
    found = recs(fx).withColumn("family", F.substring("category", 1, 2))
    depth = graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"]).groupBy(F.col("node").alias("job")).agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    share = depth.select("job", (F.col("least") / depth.agg(F.max("most")).scalar()).alias("share"))
    of_jobs = found.select("pos", F.explode("jobs").alias("job")).join(share, "job").groupBy("pos").agg(F.max("share").alias("depth_share"))
    merged = found.groupBy("rpt", "family", "job_key", "target_table").agg(F.count(F.lit(1)).alias("n_merged"))
    reach = found.groupBy("target_table", "job_key").agg(F.count_distinct("rpt").alias("n_rpts"), F.sum("est_min").alias("global_min"))
    whole = found.join(merged, ["rpt", "family", "job_key", "target_table"]).join(reach, ["target_table", "job_key"]).join(of_jobs, "pos", "left")
    whole = whole.withColumn("n_signals", F.col("pos") % 60).withColumn("unmapped", F.col("pos") % 8 == 0)
    return programme.score(whole).select("pos", "score")


@query("h09_what_if", f"""
WITH RECURSIVE d AS ({_DEPTH.format(frm="job", to="dependent_job", more="").strip()}),
gone AS (SELECT DISTINCT greatest(job_a, job_b) AS job FROM fx_recs WHERE hops > 0 AND job_a <> job_b AND greatest(job_a, job_b) NOT IN (SELECT root_job FROM fx_roots)),
l AS (SELECT job, dependent_job FROM fx_edges WHERE job NOT IN (SELECT job FROM gone) AND dependent_job NOT IN (SELECT job FROM gone)),
c(root, node) AS (SELECT root_job, root_job FROM fx_roots UNION SELECT c.root, l.dependent_job FROM c JOIN l ON l.job = c.node)
SELECT b.root, n_before, depth_before, n_after, depth_after FROM (SELECT root, count(*) AS n_before, max(depth) AS depth_before FROM d GROUP BY root) b
JOIN (SELECT c.root, count(*) AS n_after, max(depth) AS depth_after FROM c JOIN d ON d.root = c.root AND d.node = c.node GROUP BY c.root) a ON a.root = b.root
""")
def h09(fx):
    """What the reports still reach when the redundant jobs are gone."""
    depth = graph.weighted_depth(fx["fx_edges"], fx["fx_jobs"], fx["fx_roots"])
    return programme.what_if(recs(fx), fx["fx_edges"], depth)


@query("h10_category_totals", "SELECT category, rpt, count(*) AS n, sum(hops) AS hops, count(DISTINCT target_table) AS n_targets FROM fx_recs GROUP BY GROUPING SETS ((category, rpt), (category), ())")
def h10(fx):
    """Counts by category and report, with subtotals and a grand total."""
    sets = [[F.col("category"), F.col("rpt")], [F.col("category")], []]
    return fx["fx_recs"].groupingSets(sets, "category", "rpt").agg(F.count(F.lit(1)).alias("n"), F.sum("hops").alias("hops"), F.count_distinct("target_table").alias("n_targets"))


@query("h11_action_list", "SELECT rpt, pos, CAST(row_number() OVER (PARTITION BY rpt ORDER BY hops DESC, est_min DESC, pos) AS BIGINT) AS rank FROM fx_recs QUALIFY rank <= 20")
def h11(fx):
    """The first twenty actions of each report."""
    w = Window.partitionBy("rpt").orderBy(F.desc("hops"), F.desc("est_min"), "pos")
    return fx["fx_recs"].select("rpt", "pos", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 20")


@query("h12_graph_overview", "SELECT category, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT sql_object, ',' ORDER BY sql_object) AS objects FROM fx_jobs GROUP BY category")
def h12(fx):
    return fx["fx_jobs"].groupBy("category").agg(F.count(F.lit(1)).alias("n"), joined(F.collect_set("sql_object")).alias("objects"))


_PHASES = [(0, "A. Redundant", 2), (1, "B. Pass", 2), (2, "C.", 3), (3, "E.", 4), (4, "E. MV", 1)]


@query("i01_phases", "SELECT pos, CASE WHEN starts_with(category, 'A. Redundant') OR starts_with(category, 'B. Pass') THEN 2 WHEN starts_with(category, 'C.') THEN 3 WHEN starts_with(category, 'E.') THEN 4 ELSE 5 END AS phase FROM fx_recs")
def i01(fx):
    """The phase of each finding by the first prefix that fits."""
    phases = fx.spark.createDataFrame(_PHASES, "at int, prefix string, phase int")
    return programme.phase_of(fx["fx_recs"].select("pos", "category"), phases).select("pos", "phase")


@query("i02_cross_report_keys", f"SELECT CASE WHEN starts_with(category, 'F.') THEN concat('F|', category) ELSE concat(substr(category, 1, 2), '|', target_table, '|', {_KEY}) END AS dedup_key, count(*) AS n, count(DISTINCT rpt) AS n_reports FROM fx_recs GROUP BY 1")
def i02(fx):
    """Keys under which findings of several reports are the same."""
    key = F.when(F.col("category").startswith("F."), F.concat(F.lit("F|"), "category")).otherwise(F.concat_ws("|", F.substring("category", 1, 2), "target_table", "job_key"))
    return recs(fx).groupBy(key.alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rpt").alias("n_reports"))


@query("i03_credited_once", f"""
SELECT pos, CAST(CASE WHEN row_number() OVER (PARTITION BY target_table, {_KEY} ORDER BY hops > 0 DESC, pos) = 1 THEN hops ELSE 0 END AS BIGINT) AS credited FROM fx_recs
""")
def i03(fx):
    """Findings that overlap count their savings once."""
    return programme.credited_once(recs(fx)).select("pos", "credited")


@query("i04_statuses", "SELECT pos, CASE WHEN contains(lower(concat(risk, ' - ', category)), 'high') THEN 'Not to Consider' WHEN contains(lower(concat(risk, ' - ', category)), 'mv') THEN 'Consider' ELSE 'Pending' END AS status FROM fx_recs")
def i04(fx):
    """Free-text statuses to labels; pending is the default."""
    text = F.lower(F.concat_ws(" - ", "risk", "category"))
    return fx["fx_recs"].select("pos", F.when(text.contains("high"), "Not to Consider").when(text.contains("mv"), "Consider").otherwise("Pending").alias("status"))


@query("i06_executive_summary", "SELECT risk, category, count(*) AS n, sum(est_min) AS minutes FROM fx_recs GROUP BY ROLLUP (risk, category)")
def i06(fx):
    return fx["fx_recs"].rollup("risk", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("est_min").alias("minutes"))


@query("i07_master_ids", "SELECT pos, concat(rpt, '-', lpad(CAST(row_number() OVER (PARTITION BY rpt ORDER BY pos) AS VARCHAR), 5, '0')) AS id FROM fx_recs")
def i07(fx):
    """Numbered ids inside each report."""
    n = F.row_number().over(Window.partitionBy("rpt").orderBy("pos"))
    return fx["fx_recs"].select("pos", F.concat("rpt", F.lit("-"), F.lpad(n.cast("string"), 5, "0")).alias("id"))


@query("i09_report_matrix", "SELECT target_table, " + ", ".join(f"count(*) FILTER (WHERE rpt = 'RPT_{i}') > 0 AS rpt_{i}" for i in range(5)) + " FROM fx_recs GROUP BY target_table")
def i09(fx):
    """Which reports touch a table, one column each."""
    wide = fx["fx_recs"].groupBy("target_table").pivot("rpt", [f"RPT_{i}" for i in range(5)]).agg(F.count(F.lit(1)))
    return wide.select("target_table", *[(F.coalesce(f"RPT_{i}", F.lit(0)) > 0).alias(f"rpt_{i}") for i in range(5)])


@query("i10_work_orders", "WITH j AS (SELECT pos, rpt, job_a AS job FROM fx_recs UNION SELECT pos, rpt, job_b FROM fx_recs) SELECT job, count(*) AS n_recs, count(DISTINCT rpt) AS n_reports, min(pos) AS first_rec FROM j GROUP BY job")
def i10(fx):
    """What is to be done at each job."""
    each = recs(fx).select("pos", "rpt", F.explode("jobs").alias("job"))
    return each.groupBy("job").agg(F.count(F.lit(1)).alias("n_recs"), F.count_distinct("rpt").alias("n_reports"), F.min("pos").alias("first_rec"))


@query("i11_cumulative_savings", "SELECT category, n, total, CAST(sum(total) OVER (ORDER BY category) AS BIGINT) AS running FROM (SELECT category, count(*) AS n, CAST(sum(hops) AS BIGINT) AS total FROM fx_recs GROUP BY category)")
def i11(fx):
    return programme.cumulative(fx["fx_recs"], "category", "hops")


@query("i12_object_orders", """
WITH j AS (SELECT pos, rpt, risk, job_a AS job FROM fx_recs UNION SELECT pos, rpt, risk, job_b FROM fx_recs), o AS (SELECT DISTINCT j.pos, j.rpt, j.risk, n.sql_object FROM j JOIN fx_jobs n USING (job)),
c AS (SELECT sql_object, rpt, count(*) AS n FROM o GROUP BY ALL)
SELECT o.sql_object, count(DISTINCT o.pos) AS n_recs, bool_or(risk = 'HIGH') AS risky, (SELECT c.rpt FROM c WHERE c.sql_object = o.sql_object ORDER BY c.n DESC, c.rpt LIMIT 1) AS primary_rpt FROM o GROUP BY o.sql_object
""")
def i12(fx):
    """Findings by SQL object, with the report that has most of them."""
    each = recs(fx).select("pos", "rpt", "risk", F.explode("jobs").alias("job")).join(fx["fx_jobs"].select("job", "sql_object"), "job").drop("job").distinct()
    most = each.groupBy("sql_object", "rpt").agg(F.count(F.lit(1)).alias("n")).groupBy("sql_object").agg(F.min_by("rpt", F.struct(-F.col("n"), "rpt")).alias("primary_rpt"))
    by = each.groupBy("sql_object").agg(F.count_distinct("pos").alias("n_recs"), F.bool_or(F.col("risk") == "HIGH").alias("risky"))
    return by.join(most, "sql_object")


@query("i13_local_and_global", f"SELECT rpt, count(DISTINCT target_table) FILTER (WHERE d = 'EXECUTE_GLOBAL_PROGRAM') AS n_global, count(DISTINCT target_table) FILTER (WHERE g = 0) AS n_local FROM (SELECT *, {_POLICY} AS d, max(CASE WHEN {_POLICY} = 'EXECUTE_GLOBAL_PROGRAM' THEN 1 ELSE 0 END) OVER (PARTITION BY rpt, target_table) AS g FROM fx_recs) GROUP BY rpt")
def i13(fx):
    """Tables of each report with a global finding, and those with local ones alone."""
    marked = fx["fx_recs"].select("rpt", "target_table", (programme.policy(F.col("category")) == "EXECUTE_GLOBAL_PROGRAM").alias("g"))
    by = marked.groupBy("rpt", "target_table").agg(F.bool_or("g").alias("g"))
    return by.groupBy("rpt").agg(F.count_if("g").alias("n_global"), F.count_if(~F.col("g")).alias("n_local"))


@query("i14_complexity_rank", f"""
WITH r AS (SELECT *, {_KEY} AS job_key FROM fx_recs),
s AS (SELECT rpt, count(DISTINCT concat(target_table, '|', job_key)) AS n_recs, count(DISTINCT target_table) AS n_targets, count(*) FILTER (WHERE risk = 'HIGH') AS n_high FROM r GROUP BY rpt),
o AS (SELECT *, round(1.5 * n_recs + 2 * n_targets + 5 * n_high, 1) AS points FROM s), k AS (SELECT *, row_number() OVER (ORDER BY points, rpt) AS rank FROM o),
f AS (SELECT target_table, job_key, min(rank) AS rank FROM r JOIN k USING (rpt) GROUP BY target_table, job_key), n AS (SELECT rank, count(*) AS net_new FROM f GROUP BY rank)
SELECT rpt, CAST(k.rank AS BIGINT) AS rank, CAST(points AS DOUBLE) AS points, n_recs, coalesce(net_new, 0) AS net_new, CAST(sum(coalesce(net_new, 0)) OVER (ORDER BY k.rank) AS BIGINT) AS running, CASE WHEN k.rank <= 2 THEN 'EASY' WHEN k.rank <= 4 THEN 'MEDIUM' ELSE 'HARD' END AS tier FROM k LEFT JOIN n ON n.rank = k.rank
""")
def i14(fx):
    found = programme.complexity_rank(recs(fx))
    return found.withColumn("points", F.col("points").cast("double"))


@query("i15_verified_savings", "SELECT rpt, CAST(sum(hops) AS BIGINT) AS hops, count(*) FILTER (WHERE risk = 'LOW') AS low, count(*) FILTER (WHERE risk = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk = 'HIGH') AS high FROM fx_recs WHERE hops > 0 GROUP BY GROUPING SETS ((rpt), ())")
def i15(fx):
    """Savings by report with a totals row and a column per status."""
    count = lambda r: F.count_if(F.col("risk") == r)
    return fx["fx_recs"].where("hops > 0").rollup("rpt").agg(F.sum("hops").alias("hops"), count("LOW").alias("low"), count("MEDIUM").alias("medium"), count("HIGH").alias("high"))


_ROUTES = (("FCT", "aggregation"), ("DIM", "dimension"), ("MV", "view"), ("F", "general"))


@query("j01_agent_routes", "SELECT job, CASE WHEN starts_with(category, 'FCT') THEN 'aggregation' WHEN starts_with(category, 'DIM') THEN 'dimension' WHEN starts_with(category, 'MV') THEN 'view' WHEN starts_with(category, 'F') THEN 'general' ELSE 'optimizer' END AS route FROM fx_jobs")
def j01(fx):
    """The first route whose prefix fits."""
    from loomgraph.functions.columns import ladder

    return fx["fx_jobs"].select("job", ladder([(F.col("category").startswith(p), r) for p, r in _ROUTES], "optimizer").alias("route"))


@query("j02_registry", f"SELECT n.sql_object AS package, count(DISTINCT r.pos) AS n_recs, count(DISTINCT r.rpt) AS n_reports, coalesce(string_agg(DISTINCT r.risk, ',' ORDER BY r.risk), '') AS risks FROM (SELECT pos, rpt, risk, job_a AS job FROM fx_recs UNION SELECT pos, rpt, risk, job_b FROM fx_recs) r RIGHT JOIN fx_jobs n USING (job) GROUP BY n.sql_object")
def j02(fx):
    """Packages with their findings; those without have zeros."""
    each = recs(fx).select("pos", "rpt", "risk", F.explode("jobs").alias("job"))
    both = fx["fx_jobs"].select("job", F.col("sql_object").alias("package")).join(each, "job", "left")
    return both.groupBy("package").agg(F.count_distinct("pos").alias("n_recs"), F.count_distinct("rpt").alias("n_reports"), joined(F.collect_set("risk")).alias("risks"))


@query("j03_object_tables", "SELECT n.sql_object, count(DISTINCT w.tbl) AS n_written, count(DISTINCT r.tbl) AS n_read FROM fx_jobs n LEFT JOIN fx_writes w USING (job) LEFT JOIN fx_reads r USING (job) GROUP BY n.sql_object")
def j03(fx):
    """Tables that an object's jobs write and read; counted apart, so that the joins don't multiply."""
    jobs = fx["fx_jobs"].select("job", "sql_object")
    side = lambda t, n: jobs.join(fx[t], "job").groupBy("sql_object").agg(F.count_distinct("tbl").alias(n))
    named = jobs.select("sql_object").distinct()
    return named.join(side("fx_writes", "n_written"), "sql_object", "left").join(side("fx_reads", "n_read"), "sql_object", "left").fillna(0, ["n_written", "n_read"])


@query("j04_table_metadata", "SELECT w.tbl, count(*) AS n_jobs, sum(p.p_size) AS size_sum, concat(CAST(count(p.p_size) FILTER (WHERE p.p_size > 25) AS VARCHAR), '/', CAST(count(*) AS VARCHAR)) AS coverage FROM fx_writes w LEFT JOIN part p ON p.p_partkey = w.job GROUP BY w.tbl")
def j04(fx):
    info = fx["part"].select(F.col("p_partkey").alias("job"), "p_size")
    n = F.count(F.lit(1))
    return fx["fx_writes"].join(info, "job", "left").groupBy("tbl").agg(n.alias("n_jobs"), F.sum("p_size").alias("size_sum"), F.concat(F.count_if(F.col("p_size") > 25).cast("string"), F.lit("/"), n.cast("string")).alias("coverage"))


@query("j05_consumer_gaps", "SELECT tbl, count(*) AS n_gaps FROM (SELECT tbl, job FROM fx_reads EXCEPT SELECT tbl, job FROM fx_reads WHERE job % 3 = 0 EXCEPT SELECT tbl, job FROM fx_writes) GROUP BY tbl")
def j05(fx):
    """Consumers that a list lacks."""
    reads = fx["fx_reads"].select("tbl", "job")
    gaps = reads.subtract(reads.where("job % 3 = 0")).subtract(fx["fx_writes"].select("tbl", "job"))
    return gaps.groupBy("tbl").agg(F.count(F.lit(1)).alias("n_gaps"))


@query("j06_order", "SELECT sql_object, CAST(row_number() OVER (ORDER BY n DESC, sql_object) AS BIGINT) AS place FROM (SELECT sql_object, count(*) AS n FROM fx_jobs GROUP BY sql_object)")
def j06(fx):
    """Order of implementation; one row per object is ranked."""
    by = fx["fx_jobs"].groupBy("sql_object").agg(F.count(F.lit(1)).alias("n"))
    return by.select("sql_object", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "sql_object")).cast("bigint").alias("place"))


@query("h04_steps", "SELECT pos, concat('1. ', CASE substr(category, 1, 2) WHEN 'A.' THEN 'Keep one load' WHEN 'E.' THEN 'Drop the view' ELSE 'Review' END, '; 2. of ', target_table, '; 3. risk ', lower(risk)) AS steps FROM fx_recs")
def h04(fx):
    """Steps from templates; the templates are data."""
    action = F.when(F.col("category").startswith("A."), "Keep one load").when(F.col("category").startswith("E."), "Drop the view").otherwise("Review")
    return fx["fx_recs"].select("pos", F.concat(F.lit("1. "), action, F.lit("; 2. of "), "target_table", F.lit("; 3. risk "), F.lower("risk")).alias("steps"))


@query("i05_object_classes", "SELECT job, CASE WHEN category = 'MV' THEN 'MV' WHEN ends_with(job_name, '7') THEN 'VIEW' ELSE 'CODE' END AS class FROM fx_jobs")
def i05(fx):
    """Code, materialised view or view."""
    return fx["fx_jobs"].select("job", F.when(F.col("category") == "MV", "MV").when(F.col("job_name").endswith("7"), "VIEW").otherwise("CODE").alias("class"))


@query("i08_roadmap", "SELECT pos, CASE WHEN starts_with(category, 'A. Redundant') OR starts_with(category, 'B. Pass') THEN 2 WHEN starts_with(category, 'C.') THEN 3 WHEN starts_with(category, 'E.') THEN 4 ELSE 5 END AS phase, CAST(row_number() OVER (PARTITION BY rpt, CASE WHEN starts_with(category, 'A. Redundant') OR starts_with(category, 'B. Pass') THEN 2 WHEN starts_with(category, 'C.') THEN 3 WHEN starts_with(category, 'E.') THEN 4 ELSE 5 END ORDER BY pos) AS BIGINT) AS step FROM fx_recs")
def i08(fx):
    """Steps inside each report and phase."""
    phases = fx.spark.createDataFrame(_PHASES, "at int, prefix string, phase int")
    found = programme.phase_of(fx["fx_recs"].select("pos", "rpt", "category"), phases)
    return found.select("pos", "phase", F.row_number().over(Window.partitionBy("rpt", "phase").orderBy("pos")).cast("bigint").alias("step"))


@query("i16_before_after", """
WITH g AS (SELECT rpt, greatest(job_a, job_b) AS job FROM fx_recs WHERE hops > 0 AND job_a <> job_b)
SELECT rpt, count(*) AS n_jobs, count(*) FILTER (WHERE gone) AS n_removed, round(sum(CASE WHEN gone THEN 0 ELSE runtime_sec END), 1) AS sec_after FROM (
SELECT j.rpt, n.job, n.runtime_sec, EXISTS (SELECT 1 FROM g WHERE g.rpt = j.rpt AND g.job = n.job) AS gone FROM (SELECT rpt, job_a AS job FROM fx_recs UNION SELECT rpt, job_b FROM fx_recs) j JOIN fx_jobs n ON n.job = j.job) GROUP BY rpt
""")
def i16(fx):
    """Jobs and runtime of each report before and after the removal."""
    found = recs(fx)
    own = found.select("rpt", F.explode("jobs").alias("job")).distinct().join(fx["fx_jobs"].select("job", "runtime_sec"), "job")
    gone = found.where((F.col("hops") > 0) & (F.size("jobs") > 1)).select("rpt", F.explode(F.expr("slice(jobs, 2, size(jobs))")).alias("job")).distinct().withColumn("gone", F.lit(True))
    marked = own.join(gone, ["rpt", "job"], "left")
    return marked.groupBy("rpt").agg(F.count(F.lit(1)).alias("n_jobs"), F.count("gone").alias("n_removed"), F.round(F.sum(F.when(F.col("gone"), 0.0).otherwise(F.col("runtime_sec"))), 1).alias("sec_after"))


@query("j02_packages", """
WITH r AS (SELECT pos, concat('M', CAST(pos % 300 AS VARCHAR)) AS master_id, [rpt, concat('RPT_', CAST(pos % 5 AS VARCHAR))] AS rpts, CASE pos % 4 WHEN 0 THEN 'standardizer' WHEN 1 THEN 'optimizer' ELSE 'planner' END AS agent, CASE WHEN pos % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [concat('P', CAST(job_a AS VARCHAR)), concat('P', CAST(job_b AS VARCHAR))] END AS packages FROM fx_recs),
e AS (SELECT pos, master_id, agent, len(list_distinct(rpts)) AS n_rpts, (SELECT min(CAST(substr(x, 5) AS INTEGER)) FROM (SELECT unnest(rpts) AS x)) AS rank, unnest(CASE WHEN len(packages) > 0 THEN packages ELSE ['[NO PACKAGE]'] END) AS package FROM r),
b AS (SELECT package, arg_min(rank, pos) AS rank, arg_min(n_rpts, pos) AS n_rpts, list(DISTINCT agent) AS agents, count(DISTINCT master_id) AS n_recs FROM e GROUP BY package)
SELECT package, concat('RPT_', CAST(rank AS VARCHAR)) AS rpt, CAST(rank + 1 AS INTEGER) AS rank, CASE WHEN rank < 3 THEN 1 WHEN rank < 7 THEN 2 ELSE 3 END AS tier, CASE WHEN n_rpts > 1 THEN 'GLOBAL' ELSE 'LOCAL' END AS scope, array_to_string(list_sort(list_distinct(list_append(agents, 'standardizer'))), ',') AS agents, n_recs, CASE WHEN list_contains(agents, 'standardizer') THEN 'rec-driven' ELSE 'auto-final-pass' END AS mode FROM b
UNION ALL SELECT package, 'STANDALONE', 999, 4, 'STANDALONE', 'optimizer,standardizer', 0, 'free-scan' FROM (SELECT DISTINCT concat('p', CAST(p_size + 30 AS VARCHAR)) AS package FROM part) WHERE upper(package) NOT IN (SELECT upper(package) FROM b)
""")
def j02_packages(fx):
    """The registry of packages: report, tier, scope and agents, those without findings standing alone."""
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    agent = F.when(F.col("pos") % 4 == 0, "standardizer").when(F.col("pos") % 4 == 1, "optimizer").otherwise("planner")
    found = fx["fx_recs"].select(
        "pos", F.concat(F.lit("M"), (F.col("pos") % 300).cast("string")).alias("master_id"), F.array_distinct(F.array("rpt", F.concat(F.lit("RPT_"), (F.col("pos") % 5).cast("string")))).alias("rpts"),
        agent.alias("agent"), F.when(F.col("pos") % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(name("job_a"), name("job_b"))).alias("packages"),
    )
    ranks = fx.spark.createDataFrame([(f"RPT_{i}", i) for i in range(5)], "rpt string, rank int")
    return programme.registry(found, fx["part"].select(F.concat(F.lit("p"), (F.col("p_size") + 30).cast("string")).alias("package")), ranks)
