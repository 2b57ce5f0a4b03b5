"""Source and sink queries: each reads, or writes and reads back, and is held against the base rows."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomgraph.functions.columns import strip_alias, strip_schema
from loomgraph.functions.scratch import scratch_path
from loomgraph.operators import fusion
from loomgraph.sources import workbooks

from .registry import query


def _place(fx, name):
    return scratch_path(fx.spark, name)


_NATIONS = "SELECT CAST(n_regionkey AS VARCHAR) AS region, n_name AS nation, CAST(n_nationkey AS VARCHAR) AS number FROM nation"


@query("a01_workbook_scan", _NATIONS)
def a01(fx):
    """A sheet of several workbooks; headers are matched without case."""
    rows = fx["nation"].select(F.col("n_regionkey").cast("string").alias("REGION"), F.col("n_name").alias("NATION"), F.col("n_nationkey").cast("string").alias("NUMBER"))
    books = workbooks.as_workbooks(rows, "REGION", ["REGION", "NATION", "NUMBER"], "Data")
    return workbooks.parsed(books, ["region", "nation", "number"], "Data").drop("path", "pos")


@query("a02_format_switch", "SELECT s_suppkey, s_name FROM supplier")
def a02(fx):
    """Reading by the format that a path's ending names."""
    path = _place(fx, "suppliers") + ".csv"
    fx["supplier"].select("s_suppkey", "s_name").write.csv(path, header=True)
    return fx.spark.read.format(path.rpartition(".")[2]).option("header", True).schema("s_suppkey long, s_name string").load(path)


@query("a06_script_references", "SELECT script, count(*) AS n_refs, min(pos) AS first FROM (SELECT job AS script, pos FROM fx_edge_log) GROUP BY script")
def a06(fx):
    """References by script."""
    return fx["fx_edge_log"].groupBy(F.col("job").alias("script")).agg(F.count(F.lit(1)).alias("n_refs"), F.min("pos").alias("first"))


@query("a09_second_lineage_scan", "SELECT DISTINCT object, unnest(['A', 'B']) AS src, upper(tgt_table) AS tgt FROM fx_lineage_alt")
def a09(fx):
    """Cells with several names become rows; schema and alias go."""
    cell = F.explode(F.split(F.lit("own.a x, own.b"), ","))
    rows = fx["fx_lineage_alt"].select("object", cell.alias("cell"), "tgt_table")
    return rows.select("object", strip_schema(strip_alias(F.col("cell"))).alias("src"), strip_schema(F.col("tgt_table")).alias("tgt")).distinct()


@query("a13_wide_cells", "SELECT object, length(string_agg(tgt_table, ',')) > 3 AS wide, count(*) AS n FROM fx_lineage_alt GROUP BY object")
def a13(fx):
    """Very long cells survive a text file."""
    path = _place(fx, "cells")
    fx["fx_lineage_alt"].groupBy("object").agg(F.array_join(F.collect_list("tgt_table"), ",").alias("cell"), F.count(F.lit(1)).alias("n")).write.csv(path, header=True)
    rows = fx.spark.read.option("maxCharsPerColumn", -1).schema("object string, cell string, n long").csv(path, header=True)
    return rows.select("object", (F.length("cell") > 3).alias("wide"), "n")


@query("a14_edge_union", "SELECT job, dependent_job FROM fx_edge_log UNION SELECT job, dependent_job FROM fx_edge_supp")
def a14(fx):
    """The union of edges is the same under either precedence."""
    keys = ["job", "dependent_job"]
    return fusion.precedence_merge(fx["fx_edge_supp"], fx["fx_edge_log"].drop("params"), keys).select(*keys).distinct()


@query("a16_graph_json", "SELECT 'G' || CAST(job % 4 AS VARCHAR) AS rpt, job AS source, dependent_job AS target FROM fx_edges")
def a16(fx):
    """Graphs written as JSON, a map of reports, read back as relations. A graph is written in parts of some thousand links."""
    path = _place(fx, "graphs")
    links = fx["fx_edges"].select(F.concat(F.lit("G"), (F.col("job") % 4).cast("string")).alias("rpt"), F.floor(F.col("job") / 5000).alias("part"), F.struct(F.col("job").alias("source"), F.col("dependent_job").alias("target")).alias("link"))
    graphs = links.groupBy("rpt", "part").agg(F.collect_list("link").alias("links"))
    graphs.select(F.create_map("rpt", F.struct("links")).alias("graphs")).write.json(path)
    read = fx.spark.read.schema("graphs map<string, struct<links: array<struct<source: long, target: long>>>>").json(path)
    return read.select(F.explode("graphs").alias("rpt", "g")).select("rpt", F.explode("g.links").alias("l")).select("rpt", "l.source", "l.target")


@query("a17_free_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a17(fx):
    """Free-form JSON as a variant."""
    v = F.try_parse_json("props")
    return fx["events"].select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("a18_report_folders", "SELECT rpt, count(*) AS n, min(pos) AS first FROM fx_recs GROUP BY rpt")
def a18(fx):
    """Findings written into a folder per report; the report's name comes from the path."""
    path = _place(fx, "findings")
    fx["fx_recs"].select("pos", "rpt").write.partitionBy("rpt").parquet(path)
    return fx.spark.read.schema("pos long, rpt string").parquet(path).groupBy("rpt").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query("a23_whole_texts", "SELECT count(*) AS n, sum(length(body)) AS n_chars FROM fx_scripts")
def a23(fx):
    """Script files read whole, one row each."""
    path = _place(fx, "scripts")
    fx["fx_scripts"].select("body").write.option("lineSep", "\0").text(path)
    bodies = fx.spark.read.text(path, lineSep="\0")
    return bodies.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


_MODEL = "schema string, tables array<struct<name: string, columns: array<struct<id: string, name: string>>>>"


@query("c18_model_ids", "SELECT concat(CAST(n_regionkey AS VARCHAR), '_', CAST(n_nationkey AS VARCHAR)) AS id, r_name AS tbl, n_name AS col FROM nation JOIN region ON r_regionkey = n_regionkey")
def c18(fx):
    """Ids of the columns in a nested model."""
    columns = fx["nation"].join(fx["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.collect_list(F.struct(F.concat_ws("_", "n_regionkey", "n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("columns"))
    texts = columns.select(F.to_json(F.struct(F.lit("s").alias("schema"), F.array(F.struct("name", "columns")).alias("tables"))).alias("text"))
    model = texts.select(F.from_json("text", _MODEL).alias("m"))
    tables = model.select(F.explode("m.tables").alias("t"))
    return tables.select(F.col("t.name").alias("tbl"), F.explode("t.columns").alias("c")).select("c.id", "tbl", F.col("c.name").alias("col"))


@query("a24_model_dump", """
SELECT p_partkey AS script, concat('T_', CAST(p_size AS VARCHAR)) AS tbl, concat('C_', CAST(i AS VARCHAR)) AS col FROM part, (SELECT unnest(range(0, 2)) AS i) WHERE p_size % 4 <> 3 AND i <= p_size % 2
""")
def a24(fx):
    """Models out of a parser's dumps: the whole file, else its first line that begins with a brace; wrapped or flat; others say nothing."""
    columns = F.transform(F.expr("sequence(0, p_size % 2)"), lambda i: F.struct(F.concat(F.lit("C_"), i.cast("string")).alias("name")))
    flat = F.struct(F.array(F.struct(F.concat(F.lit("T_"), F.col("p_size").cast("string")).alias("name"), columns.alias("columns"))).alias("tables"))
    kind = F.col("p_size") % 4
    dump = F.when(kind == 0, F.to_json(flat)).when(kind == 1, F.to_json(F.struct(flat.alias("dbobjs")))).when(kind == 2, F.concat(F.lit("log: {x}\n  \n"), F.to_json(flat), F.lit("\ndone"))).otherwise("no model")
    path = _place(fx, "dumps")
    fx["part"].select("p_partkey", F.base64(dump.cast("binary")).alias("dump")).write.json(path)
    read = fx.spark.read.schema("p_partkey long, dump string").json(path).select(F.col("p_partkey").alias("script"), F.unbase64("dump").cast("string").alias("dump"))
    line = F.regexp_extract("dump", r"(?m)^\s*(\{.*)$", 1)
    model = "tables array<struct<name: string, columns: array<struct<name: string>>>>"
    parsed = read.select("script", F.from_json(F.when(F.ltrim("dump").startswith("{"), F.col("dump")).otherwise(line), f"{model}, dbobjs struct<{model.replace('tables ', 'tables: ', 1)}>").alias("m"))
    tables = parsed.select("script", F.explode(F.coalesce("m.tables", "m.dbobjs.tables")).alias("t"))
    return tables.select("script", F.col("t.name").alias("tbl"), F.explode("t.columns").alias("c")).select("script", "tbl", F.col("c.name").alias("col"))


@query("k01_csv_sink", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def k01(fx):
    """CSV out and in."""
    path = _place(fx, "customers")
    fx["customer"].select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return fx.spark.read.schema("c_custkey long, c_name string, c_mktsegment string").csv(path, header=True)


@query("k02_json_sink", "SELECT p_partkey, p_name, p_size FROM part")
def k02(fx):
    """JSON out and in."""
    path = _place(fx, "parts")
    fx["part"].select("p_partkey", "p_name", "p_size").write.json(path)
    return fx.spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


@query("k03_workbook_sink", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance FROM customer WHERE c_nationkey >= 0")
def k03(fx):
    """Workbooks out through the sink of that name, and in through the data source: a file for each task, all sheets read."""
    from loomgraph.sources import sinks, workbook_format

    path = _place(fx, "customer-books")
    rows = fx["customer"].where("c_nationkey >= 0").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    sinks.write(rows.repartition(4), "workbooks", path, rowsPerFile="1000")
    workbook_format.register(fx.spark)
    return fx.spark.read.format("workbooks").load(path).select("nation", "name", "balance")
