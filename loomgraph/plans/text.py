"""Queries over script texts with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import packages, scripts, summaries

from .registry import query

_N = r"[A-Za-z][A-Za-z0-9_$#.]*"
_CLEAN = r"upper(regexp_replace(trim({0}), '^.*\.', ''))"


@query("b01_descriptions", r"SELECT script, trim(regexp_extract(body, '(?im)^#\s*Description:\s*(.*)$', 1)) AS description FROM fx_scripts")
def b01(fx):
    return scripts.descriptions(fx["fx_scripts"])


@query("b02_assignments", r"SELECT script, CAST(0 AS INTEGER) AS at, 'TABLE_NAME' AS variable, regexp_extract(body, '(?m)^TABLE_NAME=(\S+)$', 1) AS value FROM fx_scripts")
def b02(fx):
    return scripts.assignments(fx["fx_scripts"])


@query("b03_remote_calls", r"SELECT script, CAST(0 AS INTEGER) AS at, regexp_extract(body, '\bssh\s+(\S+)\s+', 1) AS host, regexp_extract(body, '\bssh\s+\S+\s+\S*/([^/\s]+\.sh)', 1) AS remote_script FROM fx_scripts WHERE regexp_matches(body, '\bssh\s')")
def b03(fx):
    return scripts.remote_calls(fx["fx_scripts"])


@query("b08_inserts", rf"""
WITH q AS (SELECT script, regexp_extract(body, '(?is)\bINSERT\s+INTO\s+({_N})\s+SELECT', 1) AS target, unnest(regexp_extract_all(regexp_extract(body, '(?is)INSERT\s+INTO\s+{_N}\s+(SELECT\b.*?);', 1), '(?i)\b(?:FROM|JOIN)\s+({_N})', 1)) AS source FROM fx_scripts WHERE regexp_matches(body, '(?is)\bINSERT\s+INTO\s'))
SELECT DISTINCT script, {_CLEAN.format('target')} AS target, {_CLEAN.format('source')} AS source FROM q WHERE upper(source) <> 'DUAL'
""")
def b08(fx):
    return scripts.inserts(fx["fx_scripts"])


@query("b09_truncates", rf"SELECT script, {_CLEAN.format('t')} AS tbl FROM (SELECT script, unnest(regexp_extract_all(body, '(?i)\bTRUNCATE\s+TABLE\s+({_N})', 1)) AS t FROM fx_scripts)")
def b09(fx):
    return scripts.truncates(fx["fx_scripts"])


@query("b10_changes", rf"""
SELECT script, kind, {_CLEAN.format('t')} AS tbl FROM (
SELECT script, 'DELETE_FROM' AS kind, unnest(regexp_extract_all(body, '(?i)\bDELETE\s+(?:/\*.*?\*/\s*)?FROM\s+({_N})', 1)) AS t FROM fx_scripts
UNION ALL SELECT script, 'UPDATE_TABLE', unnest(regexp_extract_all(body, '(?i)\bUPDATE\s+(?:/\*.*?\*/\s*)?({_N})\s+SET\b', 1)) FROM fx_scripts)
""")
def b10(fx):
    return scripts.changes(fx["fx_scripts"])


@query("b07_calls", r"SELECT script, upper(regexp_extract(body, '(?i)\bexec\s+([A-Z0-9_]+)\.', 1)) AS package, upper(regexp_extract(body, '(?i)\bexec\s+[A-Z0-9_]+\.([A-Z0-9_]+)', 1)) AS procedure FROM fx_scripts WHERE regexp_matches(body, '\bexec\s')")
def b07(fx):
    return scripts.calls(fx["fx_scripts"])


@query("b11_heredocs", r"SELECT script, 'EOF' AS marker, CAST(length(regexp_extract(body, '(?s)<<EOF\n(.*?)\nEOF', 1)) AS INTEGER) AS n_chars FROM fx_scripts WHERE contains(body, '<<EOF')")
def b11(fx):
    return scripts.heredocs(fx["fx_scripts"])


@query("b13_clean_names", r"SELECT DISTINCT upper(regexp_replace(trim(regexp_replace(regexp_replace(concat('/*+ x */ \"own\".', tbl), '/\*\+?.*?\*/', '', 'g'), '[\"`]', '', 'g')), '^.*\.', '')) AS tbl FROM fx_writes".replace('\\"', '"'))
def b13(fx):
    return fx["fx_writes"].select(scripts.clean_table(F.concat(F.lit('/*+ x */ "own".'), "tbl")).alias("tbl")).distinct()


@query("b14_patterns", "SELECT p_partkey AS script, unnest(CASE p_size % 5 WHEN 0 THEN ['STATIC_SQL'] WHEN 1 THEN ['TRUNCATE_TABLE'] WHEN 2 THEN ['DELETE_FROM', 'UPDATE_TABLE'] WHEN 3 THEN ['SSH_REMOTE'] ELSE ['DIRECT_PKG_PROC_CALL'] END) AS pattern FROM part")
def b14(fx):
    return scripts.patterns(fx["fx_scripts"])


_REFS = "SELECT pos, job AS script, concat('T', CAST(dependent_job AS VARCHAR)) AS object, CASE WHEN pos % 3 = 0 THEN 'OWN' ELSE '' END AS schema, CASE WHEN pos % 4 = 0 THEN 'PACKAGE' ELSE 'PROCEDURE' END AS kind FROM fx_edge_log"


@query("b15_preferred_objects", f"SELECT script, object, schema, kind, pos FROM ({_REFS}) QUALIFY row_number() OVER (PARTITION BY script, object ORDER BY schema = '', kind <> 'PACKAGE', pos) = 1")
def b15(fx):
    log = fx["fx_edge_log"]
    refs = log.select("pos", F.col("job").alias("script"), F.concat(F.lit("T"), F.col("dependent_job").cast("string")).alias("object"), F.when(F.col("pos") % 3 == 0, "OWN").otherwise("").alias("schema"), F.when(F.col("pos") % 4 == 0, "PACKAGE").otherwise("PROCEDURE").alias("kind"))
    return scripts.preferred_objects(refs)


@query("c03_statements", """
WITH s AS (SELECT p_partkey AS script, concat('BEGIN  INSERT INTO t_', CAST(p_partkey AS VARCHAR), ' VALUES (''x;--y'', (1))') AS a, 'UPDATE u SET a = 1' AS b, p_size FROM part)
SELECT script, CAST(0 AS INTEGER) AS at, a AS statement FROM s UNION ALL SELECT script, 1, b FROM s UNION ALL SELECT script, 2, CASE WHEN p_size % 2 = 0 THEN 'COMMIT' ELSE 'END' END FROM s UNION ALL SELECT script, 3, 'END' FROM s WHERE p_size % 2 = 0
""")
def c03(fx):
    """Statements of PL/SQL texts, without comments."""
    texts = fx["part"].select(F.col("p_partkey").alias("script"), F.concat(F.lit("BEGIN /* a; /* nested */ b */ INSERT INTO t_"), F.col("p_partkey").cast("string"), F.lit(" VALUES ('x;--y', (1)); -- tail;\n UPDATE u SET a = 1; "), F.when(F.col("p_size") % 2 == 0, "COMMIT; ").otherwise(""), F.lit("END")).alias("body"))
    return scripts.split_statements(texts)


@query("c04_statement_kinds", "SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['PLSQL', 'DML', 'BOILERPLATE', 'OTHER'] ELSE ['PLSQL', 'DML', 'OTHER'] END) AS kind FROM part) GROUP BY kind")
def c04(fx):
    """Counts of statements by kind."""
    return c03(fx).groupBy(scripts.statement_kind(F.col("statement")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("c07_object_kinds", r"SELECT p_partkey AS object, CASE p_size % 4 WHEN 0 THEN 'MVIEW' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'PLSQL' ELSE 'OTHER' END AS kind FROM part")
def c07(fx):
    """The kind of an object by the head of its text."""
    heads = F.element_at(F.array(*map(F.lit, ("create materialized view x as", "Create or replace view y as", "CREATE PACKAGE BODY z is", "select 1"))), F.col("p_size") % 4 + 1)
    return fx["part"].select(F.col("p_partkey").alias("object"), scripts.statement_kind(heads).alias("kind"))


@query("c20_object_names", r"SELECT object, regexp_extract(object, '^(.*)__([^_]+)$', 1) AS package, regexp_extract(object, '^(.*)__([^_]+)$', 2) AS procedure FROM (SELECT DISTINCT concat('PKG_', tgt_table, '__', tgt_col) AS object FROM fx_lineage)")
def c20(fx):
    """Package and procedure of a joined name."""
    name = fx["fx_lineage"].select(F.concat(F.lit("PKG_"), "tgt_table", F.lit("__"), "tgt_col").alias("object")).distinct()
    return name.select("object", F.regexp_extract("object", r"^(.*)__([^_]+)$", 1).alias("package"), F.regexp_extract("object", r"^(.*)__([^_]+)$", 2).alias("procedure"))


@query("c22_listed_lines", r"""
SELECT script, CAST(i AS INTEGER) AS line, string_split(body, chr(10))[CAST(i AS INTEGER) + 1] AS text FROM (SELECT script, body, unnest(range(0, len(string_split(body, chr(10))))) AS i FROM fx_scripts) WHERE NOT starts_with(string_split(body, chr(10))[CAST(i AS INTEGER) + 1], '#')
""")
def c22(fx):
    """Lines of the scripts, comments left out."""
    lines = fx["fx_scripts"].select("script", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    return lines.where(~F.col("text").startswith("#"))


@query("c24_package_patterns", """
SELECT sql_object, CASE WHEN bool_or(category = 'FCT') AND bool_or(category = 'MV') THEN 'Hybrid' WHEN bool_or(category = 'MV') THEN 'Orchestrator' WHEN bool_or(category = 'FCT') THEN 'Self-contained' ELSE 'Independent' END AS pattern FROM fx_jobs GROUP BY sql_object
""")
def c24(fx):
    """A package's pattern by what its parts do."""
    has = lambda c: F.bool_or(F.col("category") == c)
    pattern = F.when(has("FCT") & has("MV"), "Hybrid").when(has("MV"), "Orchestrator").when(has("FCT"), "Self-contained").otherwise("Independent")
    return fx["fx_jobs"].groupBy("sql_object").agg(pattern.alias("pattern"))


@query("c25_call_counts", r"SELECT upper(regexp_extract(body, '(?i)\bexec\s+([A-Z0-9_]+)\.', 1)) AS package, count(*) AS n_calls, count(DISTINCT script) AS n_scripts FROM fx_scripts WHERE regexp_matches(body, '\bexec\s') GROUP BY 1")
def c25(fx):
    """Occurrences of external calls."""
    return scripts.calls(fx["fx_scripts"]).groupBy("package").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("script").alias("n_scripts"))


@query("c26_coverage_status", """
WITH a AS (SELECT object AS procedure, count(*) AS n_split FROM fx_lineage WHERE job % 3 <> 0 GROUP BY object), b AS (SELECT object AS procedure, count(*) AS n_json FROM fx_lineage_alt GROUP BY object)
SELECT coalesce(a.procedure, b.procedure) AS procedure, CASE WHEN a.procedure IS NULL THEN 'NO CLEANED' WHEN b.procedure IS NULL THEN 'SKIPPED' WHEN n_json >= n_split THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM a FULL JOIN b ON a.procedure = b.procedure
""")
def c26(fx):
    """Coverage of each procedure by the counts of two stages."""
    a = fx["fx_lineage"].where("job % 3 <> 0").groupBy("object").agg(F.count(F.lit(1)).alias("n_split"))
    b = fx["fx_lineage_alt"].groupBy("object").agg(F.count(F.lit(1)).alias("n_json"))
    status = F.when(F.col("n_split").isNull(), "NO CLEANED").when(F.col("n_json").isNull(), "SKIPPED").when(F.col("n_json") >= F.col("n_split"), "COMPLETE").otherwise("PARTIAL")
    return a.join(b, "object", "full").select(F.col("object").alias("procedure"), status.alias("status"))


@query("c19_column_trace", """
WITH RECURSIVE l AS (SELECT DISTINCT concat('N', CAST(dependent_job AS VARCHAR)) AS tgt, concat('N', CAST(job AS VARCHAR)) AS src FROM fx_edges),
t(start, node) AS (SELECT tgt, src FROM l UNION SELECT t.start, l.src FROM t JOIN l ON l.tgt = t.node)
SELECT DISTINCT start, node AS source FROM t WHERE node NOT IN (SELECT tgt FROM l)
""")
def c19(fx):
    """Real sources of target columns, through expression nodes."""
    from loomgraph.operators.graph import closure

    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    links = fx["fx_edges"].select(name("dependent_job").alias("job"), name("job").alias("dependent_job")).distinct()
    found = closure(links, links.select("job")).select("start", F.col("node").alias("source"))
    return found.join(links.select(F.col("job").alias("source")).distinct(), "source", "left_anti").select("start", "source").distinct()


@query("c19_labelled_trace", r"""
WITH RECURSIVE o AS (SELECT object, id, kind, name, coalesce(parent, '') AS parent FROM fx_model_objects),
ns AS (SELECT object, upper(parent) AS space, upper(name) AS called, max(id) AS meant FROM o WHERE name NOT IN ('', '*') GROUP BY ALL),
s AS (SELECT r.object, r.rel * 1000000000000 + r.nth AS step, r.target, r.source, r.source_col, upper(r.source_parent) AS space, r.source_col = '*' AS star, r.source_col <> '*' AND coalesce(o.kind, '') = 'column' AS hit,
  CASE WHEN o.kind = 'other' THEN o.name WHEN o.kind = 'other_col' THEN o.parent WHEN o.kind IS NULL THEN r.source_col ELSE '' END AS label, o.parent AS src_table, o.name AS src_col
  FROM fx_model_relations r LEFT JOIN o ON o.object = r.object AND o.id = r.source WHERE r.type NOT IN ('call', 'fdr')),
t AS (SELECT object, id, parent AS tgt_table, regexp_replace(trim(name), '^"?\s*\w+\s*\(\s*(?:\w+\.)?\s*(\w+)\s*\)\s*"?$', '\1') AS tgt_col FROM o WHERE kind = 'column' AND EXISTS (SELECT 1 FROM fx_model_relations r WHERE r.object = o.object AND r.target = o.id)),
b AS (SELECT * FROM t WHERE NOT regexp_matches(tgt_col, '(?i)^(RS-\d+|RelationRows)$') AND NOT upper(tgt_table) LIKE '%\_BKP' ESCAPE '\'),
w(object, start, node, hint, keys, path, seen, hit, src_table, src_col) AS (
  SELECT object, id, id, tgt_col, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), [id], false, '', '' FROM b
  UNION ALL
  SELECT w.object, w.start, CASE WHEN s.star THEN ns.meant ELSE s.source END, CASE WHEN s.star OR s.source_col = '' THEN w.hint ELSE s.source_col END, list_append(w.keys, s.step),
    CASE WHEN s.hit OR s.star OR s.label = '' THEN w.path ELSE list_append(w.path, s.label) END, list_append(w.seen, CASE WHEN s.star THEN ns.meant ELSE s.source END), s.hit, s.src_table, s.src_col
  FROM w JOIN s ON s.object = w.object AND s.target = w.node LEFT JOIN ns ON s.star AND ns.object = w.object AND ns.space = s.space AND ns.called = upper(w.hint)
  WHERE NOT w.hit AND (s.hit OR (CASE WHEN s.star THEN ns.meant IS NOT NULL AND NOT list_contains(w.seen, ns.meant) ELSE NOT list_contains(w.seen, s.source) END))),
h AS (SELECT b.object, b.tgt_table, b.tgt_col, w.src_table, w.src_col, w.path, row_number() OVER (PARTITION BY b.object, b.tgt_table, b.tgt_col, w.src_table, w.src_col ORDER BY w.start, w.keys) AS k
  FROM w JOIN b ON b.object = w.object AND b.id = w.start WHERE w.hit AND w.src_col NOT IN ('RelationRows', 'relationrows', '*')),
f AS (SELECT *, list_filter(path, lambda p: NOT regexp_matches(p, '(?i)^(RS-\d+|RelationRows)$')) AS shown FROM h WHERE k = 1),
u AS (SELECT *, list_filter(shown, lambda p, i: list_position(list_transform(shown, lambda q: upper(q)), upper(p)) = i) AS labels FROM f)
SELECT object, tgt_table, tgt_col, src_table, src_col, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ' -> ') ELSE 'Direct' END AS transformation FROM u
UNION ALL SELECT object, tgt_table, tgt_col, '', '', 'Constant / Expression' FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.hit AND w.object = b.object AND w.start = b.id)
""")
def c19_labelled(fx):
    """Every target column followed back to real columns, with the transformations on the first path."""
    from loomgraph.operators.trace import column_trace

    return column_trace(fx["fx_model_objects"], fx["fx_model_relations"])


@query("c29_gap_classes", "SELECT CASE WHEN src_col = '' THEN 'CONSTANT' WHEN src_col IN ('K1', 'K2') THEN 'AUDIT' ELSE 'GENUINE' END AS gap, count(*) AS n, count(DISTINCT object) AS n_objects FROM fx_lineage GROUP BY 1")
def c29(fx):
    """Gaps by class."""
    gap = F.when(F.col("src_col") == "", "CONSTANT").when(F.col("src_col").isin("K1", "K2"), "AUDIT").otherwise("GENUINE")
    return fx["fx_lineage"].groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("n_objects"))


@query("b05_parameters", "SELECT p_partkey AS script, unnest([1, 2]) AS position, CAST(1 AS BIGINT) AS n FROM part")
def b05(fx):
    """Positional parameters of scripts."""
    body = F.concat(F.lit("run $1 ${2} x"), F.col("p_partkey").cast("string"))
    return scripts.parameters(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")))


@query("b06_view_refreshes", "SELECT p_partkey AS script, CASE WHEN p_size % 2 = 0 THEN concat('MV_', CAST(p_size AS VARCHAR)) ELSE concat('MV_T', CAST(p_partkey AS VARCHAR)) END AS view, p_size % 2 = 1 AS by_variable FROM part")
def b06(fx):
    """Refreshed views, by name or variable."""
    call = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("exec dbms_mview.refresh('mv_"), F.col("p_size").cast("string"), F.lit("','C');"))).otherwise(F.lit("exec DBMS_MVIEW.REFRESH($MV_NAME);"))
    body = F.concat(F.lit("MV_NAME=mv_t"), F.col("p_partkey").cast("string"), F.lit("\n"), call)
    return scripts.view_refreshes(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")))


@query("b04_dynamic_statements", "SELECT p_partkey AS script, concat('PKG.P', CAST(p_size AS VARCHAR)) AS object, 'STATIC' AS kind FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, concat('PKG.P', CAST(p_size AS VARCHAR)), 'DYNAMIC' FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, concat('PKG.P', CAST(p_size AS VARCHAR)), 'STATIC' FROM part WHERE p_size % 3 = 2")
def b04(fx):
    """Statements that are run from texts; a literal one suppresses the built-up one of the same object."""
    name = F.concat(F.lit("pkg.p"), F.col("p_size").cast("string"))
    static = F.concat(F.lit("EXECUTE IMMEDIATE 'BEGIN "), name, F.lit("; END;';\n"))
    built = F.concat(F.lit("EXECUTE IMMEDIATE 'BEGIN "), name, F.lit("(' || v || '); END;';\n"))
    body = F.when(F.col("p_size") % 3 == 0, static).when(F.col("p_size") % 3 == 1, built).otherwise(F.concat(static, built))
    return scripts.dynamic_statements(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")))


@query("b12_variables", r"SELECT script, value, regexp_matches(value, '^\$[0-9]+$') AS is_parameter, TRY_CAST(regexp_extract(value, '^\$([0-9]+)$', 1) AS INTEGER) AS position FROM (SELECT p_partkey AS script, CASE WHEN p_size % 2 = 0 THEN concat('$', CAST(p_size AS VARCHAR)) ELSE concat('T_', CAST(p_size AS VARCHAR)) END AS value FROM part)")
def b12(fx):
    """Values of variables, and whether they are parameters."""
    value = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("T_"), F.col("p_size").cast("string")))
    return fx["part"].select(F.col("p_partkey").alias("script"), value.alias("value")).select("script", "value", F.col("value").rlike(r"^\$\d+$").alias("is_parameter"), F.regexp_extract("value", r"^\$(\d+)$", 1).try_cast("int").alias("position"))


@query("c05_without_exceptions", r"SELECT p_partkey AS script, concat('BEGIN a', CAST(p_size AS VARCHAR), '; END;') AS body FROM part")
def c05(fx):
    """Exception blocks go."""
    body = F.concat(F.lit("BEGIN a"), F.col("p_size").cast("string"), F.lit("; EXCEPTION\n WHEN OTHERS THEN NULL; END;"))
    return fx["part"].select(F.col("p_partkey").alias("script"), F.regexp_replace(body, r"(?is)\bEXCEPTION\s+WHEN\b.*?(?=\bEND\b\s*;)", "").alias("body"))


@query("c06_union_branches", "SELECT p_partkey AS script, CAST(0 AS INTEGER) AS at, 'SELECT (a UNION b)' AS branch FROM part UNION ALL SELECT p_partkey, 1, concat('SELECT ', CAST(p_size AS VARCHAR)) FROM part UNION ALL SELECT p_partkey, 2, 'SELECT ''UNION''' FROM part WHERE p_size % 2 = 0")
def c06(fx):
    """Branches of a query at its top-level unions."""
    body = F.concat(F.lit("SELECT (a UNION b) UNION ALL SELECT "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " union SELECT 'UNION'").otherwise(""))
    return scripts.split_unions(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")))


@query("c10_chunks", "SELECT script, CAST(i AS INTEGER) AS at, CASE WHEN i < 2 THEN 0 ELSE 1 END AS chunk FROM (SELECT p_partkey AS script, unnest(CASE WHEN p_size % 2 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS i FROM part)")
def c10(fx):
    """Statements filled into chunks of limited size."""
    rows = c03(fx).withColumn("statement", F.when(F.col("at") == 0, F.lpad(F.lit("x"), 40, "x")).when(F.col("at") == 1, F.lpad(F.lit("y"), 18, "y")).otherwise(F.col("statement")))
    return scripts.chunked(rows, 60)


@query("c17_stitched_parts", "SELECT object, tgt_table, count(DISTINCT src_table) AS n_sources, min(pos) AS pos FROM (SELECT regexp_replace(object, '_PART[0-9]+$', '') AS object, tgt_table, src_table, pos FROM fx_parts) GROUP BY object, tgt_table")
def c17(fx):
    """Parts of one object put together: tables are one by name, relations are counted once."""
    whole = fx["fx_parts"].withColumn("object", F.regexp_replace("object", r"_PART\d+$", ""))
    return whole.groupBy("object", "tgt_table").agg(F.count_distinct("src_table").alias("n_sources"), F.min("pos").alias("pos"))


@query("c21_superseded_parts", r"SELECT DISTINCT object FROM fx_parts p WHERE NOT (regexp_matches(object, '_PART[0-9]+$') AND EXISTS (SELECT 1 FROM fx_parts w WHERE w.object = regexp_replace(p.object, '_PART[0-9]+$', '')))")
def c21(fx):
    """A whole supersedes its parts."""
    names = fx["fx_parts"].select("object").distinct()
    base = F.regexp_replace("object", r"_PART\d+$", "")
    parts = names.where(F.col("object").rlike(r"_PART\d+$")).withColumn("base", base)
    gone = parts.join(names.withColumnRenamed("object", "base"), "base", "left_semi").select("object")
    return names.join(gone, "object", "left_anti")


@query("c23_call_sequence", "SELECT sql_object AS package, job_name AS procedure, CAST(row_number() OVER (PARTITION BY sql_object ORDER BY first, job_name) AS BIGINT) AS place FROM (SELECT n.sql_object, n.job_name, min(e.dependent_job) AS first FROM fx_jobs n JOIN fx_edges e ON e.job = n.job GROUP BY ALL)")
def c23(fx):
    """Procedures of each package in the order of their first calls."""
    from pyspark.sql import Window

    first = fx["fx_jobs"].join(fx["fx_edges"], "job").groupBy(F.col("sql_object").alias("package"), F.col("job_name").alias("procedure")).agg(F.min("dependent_job").alias("first"))
    return first.select("package", "procedure", F.row_number().over(Window.partitionBy("package").orderBy("first", "procedure")).cast("bigint").alias("place"))


@query("c28_failing_objects", r"SELECT base AS object, count(*) AS n_parts, bool_and(n_rel > 3) AS all_found FROM (SELECT regexp_replace(object, '_PART[0-9]+$', '') AS base, object, count(*) AS n_rel FROM fx_parts GROUP BY ALL) GROUP BY base")
def c28(fx):
    """Whether all parts of an object have relations."""
    each = fx["fx_parts"].groupBy("object").agg(F.count(F.lit(1)).alias("n_rel"))
    return each.groupBy(F.regexp_replace("object", r"_PART\d+$", "").alias("object")).agg(F.count(F.lit(1)).alias("n_parts"), F.bool_and(F.col("n_rel") > 3).alias("all_found"))


@query("c15_preflight", "SELECT p_partkey AS object, CASE WHEN p_size % 4 = 0 THEN 'SKIP' WHEN p_size % 4 = 1 THEN 'REJECT' ELSE 'PASS' END AS verdict FROM part")
def c15(fx):
    """Whether a text may go to a parser: not without DML, not beyond its limit."""
    dml = F.when(F.col("p_size") % 4 == 0, "BEGIN NULL; END;").otherwise(F.concat(F.lit("INSERT INTO t SELECT "), F.rpad(F.lit("x"), 40, "x")))
    text = F.when(F.col("p_size") % 4 == 1, F.rpad(dml, 10_001, " y")).otherwise(dml)
    rows = fx["part"].select(F.col("p_partkey").alias("object"), text.alias("body"))
    verdict = F.when(F.length("body") > 10_000, "REJECT").when(~F.col("body").rlike(r"(?i)\b(INSERT|UPDATE|DELETE|MERGE)\b"), "SKIP").otherwise("PASS")
    return rows.select("object", verdict.alias("verdict"))


@query("c31_findings", "SELECT p_partkey AS script, 'HOP_OPPORTUNITIES' AS section, concat('x', CAST(p_size AS VARCHAR)) AS detail FROM part UNION ALL SELECT p_partkey, 'PERFORMANCE_NOTES', 'slow' FROM part")
def c31(fx):
    """Findings of free-form summaries: sections by the pattern of their keys, lists and plain texts alike."""
    sections = F.create_map(F.lit("HOP_OPPORTUNITIES"), F.array(F.concat(F.lit("x"), F.col("p_size").cast("string"))), F.lit("METADATA_PERFORMANCE"), F.array(F.lit("no")), F.lit("PERFORMANCE_NOTES"), F.array(F.lit("slow")))
    rows = fx["part"].select(F.col("p_partkey").alias("script"), F.to_json(sections).alias("summary"))
    parsed = rows.select("script", F.explode(F.from_json("summary", "map<string, array<string>>")).alias("section", "items"))
    kept = parsed.where(F.col("section").rlike("OPPORTUNIT|PERFORMANCE") & ~F.col("section").startswith("METADATA"))
    return kept.select("script", "section", F.explode("items").alias("detail"))


@query("c13_dynamic_changes", r"SELECT p_partkey AS script, CASE WHEN p_size % 2 = 0 THEN 'MERGE' ELSE 'INSERT' END AS kind, concat('T', CAST(p_size AS VARCHAR)) AS tbl FROM part")
def c13(fx):
    """Changes written as texts and run later."""
    head = F.when(F.col("p_size") % 2 == 0, "v := 'MERGE INTO t").otherwise("v := 'INSERT INTO t")
    body = F.concat(head, F.col("p_size").cast("string"), F.lit(" x'; EXECUTE IMMEDIATE v;"))
    found = scripts.matches(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")), r"(?i)(\w+)\s*:=\s*'(MERGE|INSERT)\s+INTO\s+(\w+)[^']*'\s*;(?=[\s\S]*EXECUTE\s+IMMEDIATE\s+\1)", "variable", "kind", "tbl")
    return found.select("script", F.upper("kind").alias("kind"), F.upper("tbl").alias("tbl"))


@query("c09_cursor_targets", "SELECT p_partkey AS script, concat('SRC', CAST(p_size AS VARCHAR)) AS source, 'TGT' AS target FROM part")
def c09(fx):
    """The source of a named cursor and the table that is changed close behind it."""
    body = F.concat(F.lit("CURSOR c1 IS SELECT a FROM src"), F.col("p_size").cast("string"), F.lit(" WHERE x; BEGIN FOR r IN c1 LOOP UPDATE tgt SET a = 1; END LOOP; END;"))
    rows = fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body"))
    cursors = scripts.matches(rows, r"(?i)\bCURSOR\s+(\w+)\s+IS\s+SELECT\b[^;]*?\bFROM\s+(\w+)", "cursor", "source")
    used = scripts.matches(rows, r"(?is)\bIN\s+(\w+)\s+LOOP\b.{0,500}?\bUPDATE\s+(\w+)\s+SET", "cursor", "target")
    return cursors.drop("at").join(used.drop("at"), ["script", "cursor"]).select("script", F.upper("source").alias("source"), F.upper("target").alias("target"))


@query("c11_dispatch_branches", "SELECT p_partkey AS script, unnest(['ALPHA', 'BETA']) AS branch, unnest([concat('P', CAST(p_size AS VARCHAR)), 'Q']) AS procedure FROM part")
def c11(fx):
    """Branches of a dispatcher by its parameter, and what each calls."""
    body = F.concat(F.lit("IF UPPER(TRIM(p)) LIKE '%ALPHA%' THEN p"), F.col("p_size").cast("string"), F.lit("(1); ELSIF UPPER(TRIM(p)) LIKE '%BETA%' THEN q(2); END IF;"))
    found = scripts.matches(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")), r"(?i)IF\s+UPPER\(TRIM\(\w+\)\)\s+LIKE\s+'%(\w+)%'\s+THEN\s+(\w+)\(", "branch", "procedure")
    return found.select("script", "branch", F.upper("procedure").alias("procedure"))


@query("c08_view_bodies", "SELECT p_partkey AS script, CASE WHEN p_size % 2 = 0 THEN 'V1' ELSE 'M1' END AS view, 'select 1 from x' AS query FROM part")
def c08(fx):
    """Definitions cut down to the view's name and its query."""
    body = F.when(F.col("p_size") % 2 == 0, "CREATE OR REPLACE VIEW own.v1 (a, b) AS select 1 from x;").otherwise("create materialized view m1 BUILD IMMEDIATE REFRESH COMPLETE as select 1 from x;")
    found = scripts.matches(fx["part"].select(F.col("p_partkey").alias("script"), body.alias("body")), r"(?is)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+([\w.]+).*?\bAS\s+(SELECT\b.*?);", "view", "query")
    return found.select("script", scripts.clean_table(F.col("view")).alias("view"), "query")

# Package bodies and shell scripts of several shapes. The oracles read the same texts by regular expressions and windows.
_LINES = """
l AS (SELECT script, name, i AS line, string_split(body, chr(10))[i] AS text FROM (SELECT script, name, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM fx_packages)),
s AS (SELECT *, contains(text, '*/') AS closing, coalesce(last_value(CASE WHEN contains(text, '*/') THEN false WHEN contains(text, '/*') THEN true END IGNORE NULLS) OVER (PARTITION BY script ORDER BY line), false) AS state FROM l),
c AS (SELECT script, name, line, text, state OR starts_with(ltrim(text), '--') AS commented FROM s WHERE NOT closing)
"""


@query("c22_listed_procedures", rf"WITH {_LINES} SELECT script, CAST(line AS INTEGER) AS line, upper(regexp_extract(text, '(?i)^\s*PROCEDURE\s+(\w+)', 1)) AS procedure, commented FROM c WHERE regexp_matches(text, '(?i)^\s*PROCEDURE\s+\w+')")
def c22_procedures(fx):
    """Declared procedures, with whether they stand in a comment."""
    return packages.listed_procedures(fx["fx_packages"])


@query("c25_external_calls", rf"""
WITH {_LINES}, e AS (SELECT script, name, line, commented, upper(unnest(regexp_extract_all(text, '\b(\w+(?:\.\w+)+)\s*[;(]', 1))) AS called FROM c)
SELECT script, called, CASE WHEN regexp_matches(called, '^(PKG_GRP_LOG_UTIL|PKG_LOG_ERROR_UTILITY|PKG_GRP_COMMON_UTIL|DBMS_STATS|DBMS_MVIEW|DBMS_OUTPUT|DBMS_UTILITY|UTL_FILE|SYS\.|STANDARD\.)') THEN 'Utility / Logging' WHEN starts_with(called, 'PKG_') THEN 'Cross-Package (Functional)' WHEN regexp_matches(called, '^(PRC_|PROC_)') THEN 'Cross-PROC (Standalone)' ELSE 'Other' END AS kind,
       CAST(min(line) AS INTEGER) AS first_line, count(*) AS n, bool_and(commented) AS commented FROM e WHERE regexp_matches(called, '^(PKG_|PRC_|PROC_|DBMS_|UTL_|SYS|STANDARD)') AND called <> upper(name) AND NOT starts_with(called, upper(name) || '.') GROUP BY script, called
""")
def c25_calls(fx):
    """Calls of other packages by kind; one real call makes a name active."""
    return packages.external_calls(fx["fx_packages"])


@query("c23_main_calls", rf"""
WITH {_LINES}, d AS (SELECT *, upper(regexp_extract(text, '(?i)^\s*PROCEDURE\s+(\w+)', 1)) AS p FROM s),
g AS (SELECT *, last_value(CASE WHEN p <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY script ORDER BY line) AS start, last_value(CASE WHEN p <> '' THEN p END IGNORE NULLS) OVER (PARTITION BY script ORDER BY line) AS own FROM d),
m AS (SELECT script, max(start) AS start FROM g WHERE own = 'MAIN' GROUP BY script), b AS (SELECT g.* FROM g JOIN m USING (script, start) WHERE NOT starts_with(ltrim(text), '--') AND p = ''),
n AS (SELECT DISTINCT script, upper(regexp_extract(text, '(?i)^\s*PROCEDURE\s+(\w+)', 1)) AS procedure FROM c WHERE regexp_matches(text, '(?i)^\s*PROCEDURE\s+\w+') AND NOT regexp_matches(text, '(?i)^\s*PROCEDURE\s+MAIN\b')),
f AS (SELECT b.script, n.procedure, min(b.line * 100000 + instr(upper(b.text), n.procedure)) AS at_place FROM b JOIN n ON n.script = b.script AND regexp_matches(b.text, '(?i)\b' || n.procedure || '\b') GROUP BY ALL)
SELECT script, row_number() OVER (PARTITION BY script ORDER BY at_place, procedure) AS place, procedure, at_place // 100000 AS line FROM f
""")
def c23_calls(fx):
    """What a package's MAIN calls, in order."""
    return packages.main_calls(fx["fx_packages"]).withColumn("line", F.col("line").cast("long"))


@query("c10_package_parts")
def c10_parts(fx):
    """The procedures of a package, where they end and what becomes of them; tested against brute force."""
    return packages.package_parts(fx["fx_packages"])


@query("c12_concept_branches", rf"""
WITH {_LINES}, k AS (SELECT script, line, text, upper(rtrim(regexp_extract(text, 'LC_SOURCE_CONCEPT LIKE .([^%]+)%', 1), '%_')) AS concept FROM c WHERE NOT commented),
e AS (SELECT k.script, k.concept, k.line AS first_line, min(e.line) AS last_line FROM k JOIN k e ON e.script = k.script AND e.line > k.line AND e.text = ' END IF;' WHERE k.concept <> '' GROUP BY ALL)
SELECT e.script, e.concept, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line, count(k.line) AS n_changes
FROM e LEFT JOIN k ON k.script = e.script AND k.line > first_line AND k.line < last_line AND regexp_matches(k.text, '(?i)\b(UPDATE\s+\w|DELETE\s+FROM|MERGE\s+INTO|INSERT\s+INTO)') GROUP BY ALL
""")
def c12(fx):
    """Branches on the source concept."""
    return packages.concept_branches(fx["fx_packages"])


@query("c14_cleaned")
def c14(fx):
    """What of each package says where data comes from; tested against brute force."""
    return scripts.cleaned(fx["fx_packages"])


@query("b04_executed_calls")
def b04_calls(fx):
    """Calls in executed texts by five forms; tested against brute force."""
    return scripts.executed_calls(fx["fx_shell"])


@query("b07_direct_calls")
def b07_direct(fx):
    """Calls in SQL blocks by five forms; tested against brute force."""
    return scripts.direct_calls(fx["fx_shell"])


@query("b05_variable_positions", r"SELECT script, unnest(regexp_extract_all(body, '(\w+)\s*=\s*\$(\d+)', 1)) AS variable, concat('$', unnest(regexp_extract_all(body, '(\w+)\s*=\s*\$(\d+)', 2))) AS position FROM fx_shell")
def b05_positions(fx):
    """The parameters that variables are set from."""
    return scripts.variable_positions(fx["fx_shell"])


@query("c05_package_exceptions", r"SELECT script, regexp_replace(body, '(?is)\bEXCEPTION\s+WHEN\s+\w+\s+THEN\b.*?(\bEND\s+\w+\s*;|\bEND\s*;)', '\1', 'g') AS body FROM fx_packages")
def c05_packages(fx):
    """Package bodies without their exception handlers."""
    return fx["fx_packages"].select("script", scripts.without_exceptions(F.col("body")).alias("body"))


@query("c13_package_changes", r"SELECT script, upper(unnest(regexp_extract_all(body, '(?i)\bMERGE\s+INTO\s+([\w.]+)', 1))) AS tbl FROM fx_packages")
def c13_packages(fx):
    """Tables that the packages merge into."""
    return scripts.matches(fx["fx_packages"], r"(?i)\bMERGE\s+INTO\s+([\w.]+)", "tbl").select("script", F.upper("tbl").alias("tbl"))


@query("b06_resolved_references", r"""
WITH r AS (SELECT script, body, unnest(regexp_extract_all(body, '(?i)dbms_mview\.refresh\s*\(\s*(?:''([^'']+)''|(\w+))', 1)) AS literal, unnest(regexp_extract_all(body, '(?i)dbms_mview\.refresh\s*\(\s*(?:''([^'']+)''|(\w+))', 2)) AS var FROM fx_refresh),
o AS (SELECT script, body, coalesce(literal, '') AS literal, coalesce(var, '') AS var FROM r), i AS (SELECT *, CASE WHEN var <> '' THEN regexp_extract(body, concat('(?i)', var, '\s+\w+(?:\(\d+\))?\s*:=\s*''\$(\w+)'''), 1) ELSE '' END AS shell FROM o),
p AS (SELECT *, CASE WHEN var <> '' THEN regexp_extract(body, concat(var, '\s*=\s*\$(\d+)'), 1) ELSE '' END AS n1, CASE WHEN shell <> '' THEN regexp_extract(body, concat(shell, '\s*=\s*\$(\d+)'), 1) ELSE '' END AS n2,
  CASE WHEN var <> '' THEN regexp_extract(body, concat('(?m)', var, '\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$'), 1) ELSE '' END AS w1, CASE WHEN shell <> '' THEN regexp_extract(body, concat('(?m)', shell, '\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$'), 1) ELSE '' END AS w2 FROM i),
q AS (SELECT *, CASE WHEN n1 <> '' THEN n1 WHEN w1 = '' OR upper(w1) = upper(var) THEN n2 ELSE '' END AS n FROM p),
e AS (SELECT script, body, unnest(string_split(regexp_replace(body, '(?i)EXECUTE\s+IMMEDIATE', chr(1), 'g'), chr(1))[2:]) AS rest, unnest(range(0, len(string_split(regexp_replace(body, '(?i)EXECUTE\s+IMMEDIATE', chr(1), 'g'), chr(1))) - 1)) AS k FROM fx_refresh WHERE regexp_matches(body, '(?i)EXECUTE\s+IMMEDIATE')),
f AS (SELECT script, body, k, left(string_agg(rest, 'EXECUTE IMMEDIATE' ORDER BY k2), 500) AS text FROM (SELECT a.script, a.body, a.k, b.rest, b.k AS k2 FROM e a JOIN e b ON b.script = a.script AND b.k >= a.k) GROUP BY ALL),
u AS (SELECT *, regexp_extract_all(regexp_extract(text, '(?is)USING\s+(.*?);', 1), '\w+') AS vars FROM f)
SELECT script, CASE WHEN regexp_matches(body, concat('(?i)TRUNCATE\s+TABLE.*?', CASE WHEN var = '' THEN literal ELSE var END)) THEN 'MV_REFRESH_WITH_TRUNCATE' ELSE 'MV_REFRESH' END AS kind,
  CASE WHEN n <> '' THEN concat('(parameter $', n, ')') WHEN var = '' THEN upper(literal) WHEN w1 <> '' AND upper(w1) <> upper(var) THEN upper(w1) WHEN w2 <> '' THEN upper(w2) WHEN shell <> '' THEN upper(shell) ELSE upper(var) END AS name,
  n <> '' AS is_parameter, CASE WHEN n <> '' THEN concat('$', n) ELSE '' END AS position FROM q
UNION ALL SELECT script, 'EXECUTE_IMMEDIATE', '', regexp_matches(text, '\$\{?\w+\}?'), array_to_string(list_filter(list_transform(vars, lambda v: CASE WHEN regexp_extract(body, concat(v, '\s*=\s*\$(\d+)'), 1) <> '' THEN concat('$', regexp_extract(body, concat(v, '\s*=\s*\$(\d+)'), 1)) END), lambda x: x IS NOT NULL), ',') FROM u
""")
def b06_references(fx):
    """Refreshes and executed texts of whole scripts with the parameters behind their variables, by a table function."""
    from loomgraph.operators.resolution import references

    return references(fx["fx_refresh"]).drop("at")


@query("c11_dispatcher_branches", r"""
WITH c AS (SELECT script, regexp_replace(regexp_replace(body, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g') AS body FROM fx_dispatch),
s AS (SELECT script, string_split(rtrim(body, chr(10)), chr(10)) AS t FROM c), l AS (SELECT script, unnest(t) AS text, unnest(range(0, len(t))) AS line FROM s),
d AS (SELECT *, sum(len(regexp_extract_all(regexp_replace(upper(text), '\bEND\s+IF\b', '', 'g'), '\bIF\b')) - len(regexp_extract_all(upper(text), '\bEND\s+IF\b'))) OVER (PARTITION BY script ORDER BY line) AS depth FROM l),
t AS (SELECT *, upper(trim(regexp_extract(text, '(?i)IF\s+UPPER\s*\(\s*TRIM\s*\(\s*(\w+)\s*\)\s*\)\s+like\s+''%([^%'']+)%''', 2))) AS branch FROM d WHERE regexp_matches(text, '(?i)IF\s+UPPER\s*\(\s*TRIM\s*\(\s*(\w+)\s*\)\s*\)\s+like\s+''%([^%'']+)%''')),
e AS (SELECT t.script, t.branch, t.line AS f, coalesce((SELECT min(d.line) FROM d WHERE d.script = t.script AND d.line > t.line AND d.depth < t.depth), (SELECT max(line) FROM d WHERE d.script = t.script)) AS z FROM t),
o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.script = e.script AND x.f < e.f AND e.f <= x.z)),
b AS (SELECT o.script, branch, f AS first_line, z AS last_line, string_agg(d.text, chr(10) ORDER BY d.line) AS body FROM o JOIN d ON d.script = o.script AND d.line > f AND d.line < z GROUP BY ALL)
SELECT script, branch, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line, body, CAST(len(regexp_extract_all(body, '(?is)\b(INSERT\s+INTO|UPDATE\s+\w+|DELETE\s+FROM|MERGE\s+INTO)\b')) AS INTEGER) AS n_changes FROM b WHERE trim(body) <> ''
""")
def c11_branches(fx):
    """Branches of dispatchers with what they change, nested IFs and all."""
    from loomgraph.operators.branches import dispatch_branches

    return dispatch_branches(fx["fx_dispatch"])


@query("c10_sized_parts", r"""
WITH RECURSIVE s AS (SELECT script, header, list_filter(list_transform(regexp_split_to_array(body, '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS g, body FROM fx_statements),
b AS (SELECT script, header, g FROM s WHERE length(header) + length(body) + 1 > 10000 AND len(g) > 0),
w(script, header, g, i, part, size, has) AS (
  SELECT script, header, g, 1, 1, length(header) + 50 + length(g[1]) + 2, ends_with(g[1], ';') FROM b
  UNION ALL SELECT script, header, g, i + 1, CASE WHEN has AND size + length(g[i + 1]) + 2 > 9500 THEN part + 1 ELSE part END,
    CASE WHEN has AND size + length(g[i + 1]) + 2 > 9500 THEN length(header) + 50 ELSE size END + length(g[i + 1]) + 2, CASE WHEN has AND size + length(g[i + 1]) + 2 > 9500 THEN false ELSE has END OR ends_with(g[i + 1], ';') FROM w WHERE i < len(g)),
p AS (SELECT script, header, part, string_agg(g[i], chr(10) || chr(10) ORDER BY i) AS t FROM w GROUP BY script, header, part),
n AS (SELECT *, count(*) OVER (PARTITION BY script) AS n FROM p),
a AS (SELECT script, part, n AS n_parts, concat(header, ' (part ', part, '/', n, ')', chr(10), chr(10), t) AS content FROM n UNION ALL SELECT script, 1, 1, concat(header, chr(10), body) FROM s WHERE length(header) + length(body) + 1 <= 10000 AND regexp_replace(body, '\s', '', 'g') <> '')
SELECT script, CAST(part AS INTEGER) AS part, CAST(n_parts AS INTEGER) AS n_parts, CAST(length(content) AS INTEGER) AS n_chars, length(content) <= 10000 AS fits, md5(content) AS content_md5 FROM a
""")
def c10_sized(fx):
    """Texts of more than 10,000 characters in parts that end behind statements."""
    from loomgraph.operators.branches import sized_parts

    return sized_parts(fx["fx_statements"]).withColumn("content_md5", F.md5("content")).drop("content")


@query("c31_consolidated", """
WITH j AS (SELECT script, CAST(summary AS JSON) AS s FROM fx_free_summaries WHERE json_valid(summary)), k AS (SELECT script, s, unnest(json_keys(s)) AS key FROM j WHERE NOT list_contains(json_keys(s), 'error')),
o AS (SELECT script, key, json_extract(s, concat('$."', key, '"')) AS v FROM k WHERE regexp_matches(lower(key), 'issue|risk|bug|problem|potential|warning|recommendation|improvement|suggestion|action|optimization|performance|refactor|smell') AND NOT regexp_matches(lower(key), '^(name|object|schema|package|procedure|script|type|summary|purpose|signature|column|source_table|select|parameter|input|output|entry|status|comment|description|grant|target|declared|creation|build|parallel|refresh|constraint|storage|segment)')),
t AS (SELECT script, key, sub, json_extract(v, concat('$."', sub, '"')) AS v FROM (SELECT script, key, v, unnest(json_keys(v)) AS sub FROM o WHERE json_type(v) = 'OBJECT')),
i AS (SELECT script, key AS section, unnest(CAST(v AS JSON[])) AS v FROM o WHERE json_type(v) = 'ARRAY' UNION ALL SELECT script, concat(key, '.', sub), unnest(CAST(v AS JSON[])) FROM t WHERE json_type(v) = 'ARRAY')
SELECT script, key AS section, v->>'$' AS detail, CAST(NULL AS BIGINT) AS n_fields FROM o WHERE json_type(v) = 'VARCHAR' AND trim(v->>'$') <> ''
UNION ALL SELECT script, key, concat(sub, ': ', v->>'$'), NULL FROM t WHERE json_type(v) = 'VARCHAR' AND trim(v->>'$') <> ''
UNION ALL SELECT script, section, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'$.detail' ELSE v->>'$' END, CASE WHEN json_type(v) = 'OBJECT' THEN len(json_keys(v)) END FROM i WHERE json_type(v) = 'OBJECT' OR json_type(v) = 'VARCHAR' AND trim(v->>'$') <> ''
""")
def c31_consolidated(fx):
    """Findings of free-form summaries in all shapes: lists, objects of lists and texts, texts."""
    found = summaries.consolidated_findings(fx["fx_free_summaries"])
    return found.select("script", "section", "detail", F.size(F.json_object_keys("fields")).cast("long").alias("n_fields"))


@query("c15_verdicts", r"""
WITH d AS (SELECT object FROM fx_dumps WHERE json_valid(string_split(dump, concat(chr(10), 'Error log:'))[1]) AND json_array_length(CAST(string_split(dump, concat(chr(10), 'Error log:'))[1] AS JSON), '$.relationships') > 0),
r AS (SELECT object, CASE WHEN object IN (SELECT object FROM d) THEN 'done' WHEN length(body) > 10000 THEN 'too long' WHEN NOT regexp_matches(body, '(?i)\b(INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|MERGE\s+INTO|UPDATE\s+\w|DELETE\s+(FROM\s+)?\w)\b') THEN 'no change'
  WHEN regexp_matches(body, '(?i)EXECUTE\s+IMMEDIATE\s+\w+\s*\|\|') THEN 'dynamic text put together' WHEN regexp_matches(body, '(?i)EXECUTE\s+IMMEDIATE\s+\w+\s*;') THEN 'dynamic text of a variable' WHEN regexp_matches(body, '(?i)SYS\.XMLTYPE\s*\(') THEN 'XML type' WHEN regexp_matches(body, '(?i)XMLELEMENT\s*\(') THEN 'XML element'
  WHEN regexp_matches(body, '(?im)^--\s+Lineage:\s+Cursor') THEN 'cursor only' WHEN len(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l), '--'))) < 3 THEN 'empty' ELSE 'has changes' END AS reason FROM fx_cleaned)
SELECT object, reason, CASE reason WHEN 'done' THEN 'SKIP' WHEN 'has changes' THEN 'PASS' ELSE 'REJECT' END AS verdict FROM r
""")
def c15_verdicts(fx):
    """Whether cleaned texts may go to the parser, and why not."""
    from loomgraph.operators.branches import preflight

    return preflight(fx["fx_cleaned"], fx["fx_dumps"])


@query("b14_recognised", r"""
WITH p(pattern, test) AS (VALUES ('SSH_REMOTE', '\bssh\s+\S+\s+\S+\.sh'), ('STATIC_SQL', '(?is)\bINSERT\s+INTO\s+[\w.]+\s+SELECT\b.*?\b(?:FROM|JOIN)\s+(?:[A-Z]+\.)?[SR]'), ('TRUNCATE_TABLE', '(?i)\bTRUNCATE\s+TABLE\s+[A-Z]'), ('DELETE_FROM', '(?i)\bDELETE\s+(?:/\*.*?\*/\s*)?FROM\s+[A-Z]'), ('UPDATE_TABLE', '(?i)\bUPDATE\s+[\w.]+\s+SET\b'), ('DIRECT_PKG_PROC_CALL', '(?i)\bexec\s+\w+\.\w+')),
f AS (SELECT script, pattern FROM fx_mixed_scripts JOIN p ON regexp_matches(coalesce(body, ''), test))
SELECT script, pattern FROM f UNION ALL SELECT script, CASE WHEN regexp_matches(coalesce(body, ''), '(?i)sqlplus') THEN 'UNKNOWN' ELSE 'NO_SQL' END FROM fx_mixed_scripts WHERE script NOT IN (SELECT script FROM f)
""")
def b14_recognised(fx):
    """The patterns of whole scripts, and what those without any are."""
    return scripts.patterns(fx["fx_mixed_scripts"])


#: Package bodies as the oracle reads them: without comments (hints are comments too), semicolons inside parentheses shielded.
_BARE = r"bare AS (SELECT script, regexp_replace(regexp_replace(body, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g') AS body FROM fx_packages)"
_SHIELDED = rf"{_BARE}, shielded AS (SELECT script, regexp_replace(body, '\(([^();]*);([^();]*)\)', concat('(\1', chr(1), '\2)'), 'g') AS body FROM bare), parts AS (SELECT script, list_filter(list_transform(string_split(body, ';'), lambda x: replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(1), ';')), lambda x: x <> '') AS s FROM shielded)"


@query("c01_without_comments", f"WITH {_BARE} SELECT script, length(body) AS n_chars, md5(body) AS body_md5 FROM bare")
def c01(fx):
    """Whole package bodies without block and line comments."""
    from loomgraph.operators.branches import uncommented

    bare = fx["fx_packages"].select("script", uncommented("body").alias("body"))
    return bare.select("script", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


@query("c03_package_statements", f"WITH {_SHIELDED} SELECT script, CAST(unnest(range(0, len(s))) AS INTEGER) AS at, unnest(s) AS statement FROM parts")
def c03_packages(fx):
    """The statements of whole package bodies in their order."""
    return scripts.split_statements(fx["fx_packages"])


@query("c04_package_kinds", rf"""
WITH {_SHIELDED}, u AS (SELECT script, upper(unnest(s)) AS t FROM parts)
SELECT kind, count(*) AS n, count(DISTINCT script) AS n_scripts FROM (SELECT script, CASE WHEN regexp_matches(t, '^(INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b') THEN 'DML' WHEN regexp_matches(t, '^CREATE\s+MATERIALIZED\s+VIEW\b') THEN 'MVIEW' WHEN regexp_matches(t, '^CREATE\s+(OR\s+REPLACE\s+)?VIEW\b') THEN 'VIEW' WHEN regexp_matches(t, '^(CREATE\s+(OR\s+REPLACE\s+)?(PACKAGE|PROCEDURE|FUNCTION)|BEGIN|DECLARE)\b') THEN 'PLSQL' WHEN regexp_matches(t, '^(COMMIT|ROLLBACK|EXIT|NULL)\b') THEN 'BOILERPLATE' ELSE 'OTHER' END AS kind FROM u) GROUP BY kind
""")
def c04_packages(fx):
    """Kinds of the statements of whole package bodies."""
    return scripts.split_statements(fx["fx_packages"]).groupBy(scripts.statement_kind(F.col("statement")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("script").alias("n_scripts"))


@query("c06_view_branches", r"""
WITH s AS (SELECT script, regexp_replace(body, '\(([^()]*?)(UNION)([^()]*?)\)', concat('(\1', chr(1), '\3)'), 'gi') AS body FROM fx_view_bodies),
m AS (SELECT script, regexp_replace(body, '(?i)\bUNION(\s+ALL)?\b', chr(2), 'g') AS body FROM s), p AS (SELECT script, list_transform(string_split(body, chr(2)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS b FROM m)
SELECT script, CAST(unnest(range(0, len(b))) AS INTEGER) AS at, len(b) AS n_branches, regexp_extract(unnest(b), '(?i)\bFROM\s+(own\.\w+)', 1) AS first_table, upper(replace(unnest(b), chr(1), 'UNION')) AS branch FROM p
""")
def c06_views(fx):
    """The branches of view queries between unions outside of parentheses, with the first own table of each."""
    found = scripts.split_unions(fx["fx_view_bodies"])
    n = found.groupBy("script").agg(F.count(F.lit(1)).alias("n_branches"))
    return found.join(n, "script").select("script", "at", "n_branches", F.regexp_extract("branch", r"(?i)\bFROM\s+(own\.\w+)", 1).alias("first_table"), F.upper("branch").alias("branch"))
