"""Hand-made cases for each semantic trap."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import detect, fusion, graph, programme, scripts


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "job long, dependent_job long")


def jobs(spark, n, passed=(), stops=()):
    return spark.createDataFrame([(i, i in passed, i in stops, float(i)) for i in range(n)], "job long, is_pass boolean, is_stop boolean, runtime_sec double")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root_job long")


def test_transparent_nodes_cost_nothing(spark):
    found = graph.weighted_depth(edges(spark, (0, 1), (0, 2), (1, 3), (2, 3)), jobs(spark, 4, passed=(2,)), roots(spark, 0))
    assert {(r.node, r.depth) for r in found.collect()} == {(0, 0), (1, 1), (3, 1)}


def test_barriers_are_not_passed(spark):
    found = graph.weighted_depth(edges(spark, (0, 1), (1, 2), (0, 3)), jobs(spark, 4, stops=(1,)), roots(spark, 0))
    assert {r.node for r in found.collect()} == {0, 3}


def test_depth_ends_on_a_cycle(spark):
    found = graph.weighted_depth(edges(spark, (0, 1), (1, 2), (2, 0), (2, 3)), jobs(spark, 4), roots(spark, 0))
    assert {(r.node, r.depth) for r in found.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_strong_components(spark):
    found = graph.strong_components(edges(spark, (0, 1), (1, 2), (2, 0), (2, 3), (4, 4), (3, 5), (5, 6), (6, 5)))
    assert {(r.node, r.component) for r in found.collect()} == {(0, 0), (1, 0), (2, 0), (4, 4), (5, 5), (6, 5)}


def test_critical_path(spark):
    found = graph.critical_path(edges(spark, (0, 1), (0, 2), (1, 3), (2, 3)), jobs(spark, 4), roots(spark, 0))
    assert [(r.step, r.node) for r in found.orderBy("step").collect()] == [(0, 0), (1, 2), (2, 3)]


def test_topological_levels_rise_along_edges(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 2), (2, 3))
    level = {r.node: r.level for r in graph.topological_levels(e).collect()}
    assert all(level[r.job] < level[r.dependent_job] for r in e.collect())


def test_order_puts_cycles_last(spark):
    nodes = spark.createDataFrame([("r", i, 5 - i, 0) for i in range(4)], "rpt string, node long, depth int, rank int")
    links = spark.createDataFrame([("r", 3, 0), ("r", 1, 2), ("r", 2, 1)], "rpt string, source long, target long")
    assert [(r.step, r.node) for r in graph.execution_order(nodes, links).orderBy("step").collect()] == [(1, 3), (2, 0), (3, 1), (4, 2)]


def test_numbers_over_many_partitions(spark):
    from loomgraph.functions.numbering import numbered

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")).repartition(7)
    found = numbered(rows, "g", [F.desc("v")], "n").collect()
    assert {(r.g, r.v, r.n) for r in found} == {(g, v, i + 1) for g in range(3) for i, v in enumerate(sorted((x for x in range(500) if x % 3 == g), reverse=True))}


def test_loops_compact_their_deltas(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    e = edges(spark, *[(i, i + 1) for i in range(9)], (0, 9))
    assert {(r.node, r.depth) for r in graph.weighted_depth(e, jobs(spark, 10), roots(spark, 0)).collect()} == {(i, min(i, 1 if i == 9 else i)) for i in range(10)}
    assert {(r.start, r.node, r.hops) for r in graph.closure(e, jobs(spark, 1).select("job")).collect()} == {(0, i, 1 if i == 9 else i) for i in range(1, 10)}
    assert [r.node for r in graph.critical_path(e, jobs(spark, 10), roots(spark, 0), at_once=2).orderBy("step").collect()] == list(range(10))
    assert {(r.node, r.level) for r in graph.topological_levels(e).collect()} == {(i, i) for i in range(10)}


def test_latest_edges_fill_each_column_by_itself(spark):
    log = spark.createDataFrame([(1, 1, 2, None, "p"), (2, 1, 2, " c ", "")], "pos long, job long, dependent_job long, cmd string, params string")
    assert [tuple(r) for r in fusion.latest_edges(log).collect()] == [(1, 2, 1, "c", "p")]


def test_cascade_takes_the_first_key(spark):
    rows = spark.createDataFrame([(1, "PKG")], "id long, package string")
    lookup = spark.createDataFrame([("PKG__T", 1), ("PKG_PRC", 2)], "key string, n int")
    found = fusion.key_cascade(rows, "id", [F.lit("NONE"), F.concat("package", F.lit("__T")), F.concat("package", F.lit("_PRC"))], lookup, "key").collect()
    assert [(r.priority, r.key, r.n) for r in found] == [(1, "PKG__T", 1)]


def test_runtime_estimates(spark):
    rows = spark.createDataFrame([("D. x", [5.0, 3.0, 2.0], 1), ("M. x", [5.0, 3.0], 1), ("A. x", [9.0, 1.0, 4.0], 2), ("F. x", [9.0], 1)], "c string, r array<double>, h int")
    found = rows.select(programme.runtime_estimate(F.col("c"), F.col("r"), F.col("h")).alias("v")).collect()
    assert [r.v for r in found] == [5.0, 3.0, 5.0, 0.0]


def test_serial_chains(spark):
    kinds = spark.createDataFrame([(i, "OTHER") for i in range(6)], "job long, category string")
    found = detect.serial_chains(edges(spark, (0, 1), (1, 2), (3, 4), (3, 5)), kinds)
    assert {(r.first, r.job, r.step) for r in found.collect()} == {(0, 0, 0), (0, 1, 1), (0, 2, 2)}


def test_clusters_are_greedy(spark):
    from collections import defaultdict

    from loomgraph.sources.fixtures import Fixtures

    rows = Fixtures(spark, "/root/testdata/sf0.001")["fx_lineage"].select("pos", "tgt_table", "job", "tgt_col").collect()
    sets, first = defaultdict(set), {}
    for r in rows:
        sets[(r.tgt_table, r.job)].add(r.tgt_col)
        first[(r.tgt_table, r.job)] = min(first.get((r.tgt_table, r.job), r.pos), r.pos)
    wanted, clusters = set(), defaultdict(list)
    for key in sorted(sets, key=first.get):
        home = next((c for c in clusters[key[0]] if all(len(sets[key] & sets[o]) >= 0.85 * len(sets[key] | sets[o]) for o in c)), None)
        if home is None:
            clusters[key[0]].append(home := [])
        home.append(key)
    wanted = {(t, i, j) for t, found in clusters.items() for i, c in enumerate(found) if len(c) > 1 for _, j in c}
    found = detect.similar_clusters(Fixtures(spark, "/root/testdata/sf0.001")["fx_lineage"])
    assert {(r.tgt_table, r.cluster, r.job) for r in found.collect()} == wanted


def test_comments_and_statements():
    text = "a /* x /* y */ z */ b -- c;\n'--;' (1;2); d"
    assert scripts.statements(scripts.without_comments(text)) == ["a  b \n'--;' (1;2)", "d"]


def test_empty_relations(spark):
    none = edges(spark, (0, 1)).limit(0)
    assert graph.weighted_depth(none, jobs(spark, 2), roots(spark, 0)).count() == 1
    assert graph.closure(none, jobs(spark, 2)).count() == 0
    assert graph.strong_components(none).count() == 0
    assert fusion.neighbour_lists(none).count() == 0


def test_stream_equals_batch(spark):
    from loomgraph.plans.registry import queries

    a, b = (sorted(map(str, queries()[n](spark, "/root/testdata/sf0.001").collect())) for n in ("rel_p_windows", "rel_p_streamed_windows"))
    assert a == b


def test_workbooks(spark):
    import io
    import zipfile

    from loomgraph.sources import workbooks as w

    rows = [["A", None, "é <&>"], [None, "2"], []]
    assert w.sheet_rows(w.workbook_bytes([["X", "Y", "Z"], *rows])) == [["X", "Y", "Z"], ["A", None, "é <&>"], [None, "2"], []]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(w.workbook_bytes([["h"]], "Other"))) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, a.read(n) if "sheet1" not in n else f'<worksheet xmlns="{w.MAIN[1:-1]}"><sheetData><row><c r="AA1" t="s"><v>1</v></c></row></sheetData></worksheet>')
        b.writestr("xl/sharedStrings.xml", f'<sst xmlns="{w.MAIN[1:-1]}"><si><t>no</t></si><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>')
    assert w.sheet_rows(out.getvalue(), "Other") == [[None] * 26 + ["shared"]]
    files = spark.createDataFrame([("a", w.workbook_bytes([["name", "n"], ["x", "1"], ["y"]]))], "path string, content binary")
    assert [tuple(r) for r in w.parsed(files, ["N", "NAME", "none"]).orderBy("pos").collect()] == [("a", 0, "1", "x", None), ("a", 1, None, "y", None)]


def test_stream_keeps_the_first_of_each_edge(spark, tmp_path):
    from loomgraph.streaming.runs import latest_edges

    rows = [(1, 2, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:20:00")]
    log = spark.createDataFrame(rows, "job long, dependent_job long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = latest_edges(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"))
    feed.writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.job, r.dependent_job) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 2), (1, 3)]


def test_similar_jobs_of_one_set_in_many_tasks(spark):
    """jobs with equal sets are paired block by block; before, one task had all pairs of a set."""
    from pyspark.sql import functions as F

    from loomgraph.operators import detect

    sets = {j: "ABCDEFG" if j % 10 else "ABCDEF" if j % 20 else "XY" for j in range(100)}
    lineage = spark.createDataFrame([("T", j, c) for j, s in sets.items() for c in s], "tgt_table string, job long, tgt_col string")
    wanted = [("T", a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = lineage.where((F.col("job") % 10) != 0)
        assert detect.similar_jobs(one, block=20).select(F.spark_partition_id()).distinct().count() > 1
        assert sorted(map(tuple, detect.similar_jobs(lineage, block=20).collect())) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
