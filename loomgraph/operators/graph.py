"""Graph operators over edge relations: each is a fixpoint of joins, one frontier for all roots.

``edges`` has (job, dependent_job): job needs dependent_job. A round joins the frontier with the edges and goes on with
what is new or better than what is known. Only that is written, to the shared folder: what is known is the union of the
rounds' deltas, put together again after ``ROUNDS`` of them. So plans stay short, disk holds about one copy of the result
beside the rounds', and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.numbering import numbered
from loomgraph.functions.scratch import materialize

#: Deltas after which what is known is written anew.
ROUNDS = 8


class Known:
    """What rounds have found so far: a union of written deltas."""

    def __init__(self, first: DataFrame, best: Callable[[DataFrame], DataFrame]):
        self.deltas, self.best = [first], best

    def all(self) -> DataFrame:
        out = self.deltas[0]
        for d in self.deltas[1:]:
            out = out.unionByName(d)
        return out

    def add(self, delta: DataFrame) -> None:
        self.deltas.append(delta)
        if len(self.deltas) > ROUNDS:
            self.deltas = [materialize(self.best(self.all()), "known")]

    def result(self) -> DataFrame:
        return self.best(self.all())


def weighted_depth(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): the least number of steps from each root, where nodes with ``is_pass`` cost nothing.

    Such nodes are passed but not returned; nodes with ``is_stop`` are neither returned nor passed. ``nodes`` has (job,
    is_pass, is_stop), ``roots`` has (root_job). A root has depth 0, whatever its flags.
    """
    nodes = nodes.select("job", "is_pass", "is_stop").hint("merge")  # a row per node: the files that it comes from may look small
    steps = edges.join(nodes, edges["dependent_job"] == nodes["job"]).where(~F.col("is_stop"))
    steps = materialize(steps.select(edges["job"].alias("from"), F.col("dependent_job").alias("to"), F.when(F.col("is_pass"), 0).otherwise(1).alias("w")), "steps")
    frontier = roots.select(F.col("root_job").alias("root"), F.col("root_job").alias("node"), F.lit(0).alias("depth")).distinct()
    known = Known(frontier, lambda df: df.groupBy("root", "node").agg(F.min("depth").alias("depth")))
    while True:
        reached = frontier.join(steps, frontier["node"] == steps["from"]).groupBy("root", F.col("to").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        old = known.all().toDF("o_root", "o_node", "o_depth").hint("merge")
        fresh = reached.join(old, (F.col("root") == F.col("o_root")) & (F.col("node") == F.col("o_node")) & (F.col("o_depth") <= F.col("depth")), "left_anti")
        frontier = materialize(fresh, "frontier")
        if frontier.isEmpty():
            break
        known.add(frontier)
    flags = nodes.select(F.col("job").alias("node"), "is_pass")
    found = known.result().join(flags.hint("merge"), "node", "left").where((F.col("node") == F.col("root")) | ~F.coalesce("is_pass", F.lit(False)))
    return found.select("root", "node", F.col("depth").cast("int").alias("depth"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dependent_job").alias("job"), F.col("job").alias("dependent_job"))


def closure(edges: DataFrame, starts: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(start, node, hops): all nodes reachable from each start by at least one edge, and the fewest edges to them."""
    pairs = edges.select(F.col("job").alias("from"), F.col("dependent_job").alias("to")).distinct()
    frontier = starts.select(F.col("job").alias("start"), F.col("job").alias("node")).distinct()
    known: Known | None = None
    hops = 0
    while most_rounds is None or hops < most_rounds:
        hops += 1
        reached = frontier.join(pairs, frontier["node"] == pairs["from"]).select("start", F.col("to").alias("node")).distinct()
        if known is not None:
            reached = reached.join(known.all(), ["start", "node"], "left_anti")
        delta = materialize(reached.withColumn("hops", F.lit(hops)), "frontier")
        if known is not None and delta.isEmpty():
            break
        if known is None:
            known = Known(delta, lambda df: df)  # a pair is found once
        else:
            known.add(delta)
        frontier = delta.select("start", "node")
    return known.result() if known is not None else frontier.withColumn("hops", F.lit(0))


def longest_paths(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, total, parent): the largest summed runtime of a path from each root, on an acyclic graph.

    Of paths with equal totals the one by the smaller parent counts. On a cyclic graph the rounds end with the number of nodes.
    """
    cost = nodes.select(F.col("job").alias("to"), F.col("runtime_sec").alias("cost"))
    steps = materialize(edges.select(F.col("job").alias("from"), F.col("dependent_job").alias("to")).join(cost, "to"), "steps")
    frontier = roots.select(F.col("root_job").alias("root"), F.col("root_job").alias("to")).distinct().join(cost, "to").select("root", F.col("to").alias("node"), F.col("cost").alias("total"), F.lit(None).cast("long").alias("parent"))

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy("root", "node").agg(F.max(F.struct("total", (-F.col("parent")).alias("back"))).alias("b")).select("root", "node", "b.total", (-F.col("b.back")).alias("parent"))

    known = Known(materialize(frontier, "paths"), best)
    for _ in range(nodes.count()):
        one = frontier.join(steps, frontier["node"] == steps["from"]).select("root", F.col("to").alias("node"), (F.col("total") + F.col("cost")).alias("total"), F.col("from").alias("parent"))
        old = known.all().toDF("o_root", "o_node", "o_total", "o_parent")
        as_good = (F.col("o_total") > F.col("total")) | ((F.col("o_total") == F.col("total")) & (F.col("o_parent").isNull() | (F.col("o_parent") <= F.col("parent"))))
        frontier = materialize(best(one).join(old, (F.col("root") == F.col("o_root")) & (F.col("node") == F.col("o_node")) & as_good, "left_anti"), "paths")
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.result()


def critical_path(edges: DataFrame, nodes: DataFrame, roots: DataFrame, at_once: int = 4) -> DataFrame:
    """(root, step, node, total): the longest path of each root from its root (step 0) to its end.

    A round walks ``at_once`` parents up; it holds so many rows of each root.
    """
    paths = materialize(longest_paths(edges, nodes, roots), "paths")
    ends = paths.groupBy("root").agg(F.max(F.struct("total", (-F.col("node")).alias("back"))).alias("e")).select("root", (-F.col("e.back")).alias("node"))
    walk = ends.join(paths, ["root", "node"]).withColumn("up", F.lit(0))
    out = None
    while True:
        steps = walk
        for _ in range(at_once):
            parents = walk.select("root", F.col("parent").alias("node"), (F.col("up") + 1).alias("up")).where("node is not null")
            walk = parents.join(paths, ["root", "node"]).select(*steps.columns)
            steps = steps.unionByName(walk)
        steps = materialize(steps, "walk")
        out = steps if out is None else out.unionByName(steps)
        top = steps.groupBy("root").agg(F.max("up").alias("up"))  # goes on from here
        walk = steps.join(top, ["root", "up"]).where("parent is not null")
        walk = walk.select("root", F.col("parent").alias("node"), (F.col("up") + 1).alias("up")).join(paths, ["root", "node"]).select(*steps.columns)
        if walk.isEmpty():
            break
    length = out.groupBy("root").agg(F.max("up").alias("top"))
    return out.join(length, "root").select("root", (F.col("top") - F.col("up")).cast("int").alias("step"), "node", "total")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other, named by their smallest node; single nodes are left out.

    Rounds of colouring: each node takes the smallest node that reaches it, then those that reach back within one
    colour form the component of that colour; they leave the graph and the rest goes on.
    """
    pairs = materialize(edges.select(F.col("job").alias("a"), F.col("dependent_job").alias("b")).distinct(), "pairs")
    found, n = None, pairs.count()
    while True:
        before = -1
        while n != before:  # nodes without an edge in or out can't be in a cycle
            pairs = materialize(pairs.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "pairs")
            before, n = n, pairs.count()
        if not n:
            break
        colours = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select("b").toDF("node")).distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            met = pairs.join(colours, pairs["a"] == colours["node"]).groupBy("b").agg(F.min("colour").alias("new"))
            after = materialize(colours.join(met, colours["node"] == met["b"], "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.col("colour").alias("old")), "colours")
            colours = after.select("node", "colour")
            if after.where("colour <> old").isEmpty():
                break
        ca, cb = colours.toDF("a", "c_a"), colours.toDF("b", "c_b")
        within = materialize(pairs.join(ca, "a").join(cb, "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("colour")), "within")
        back = frontier = materialize(colours.where("node = colour"), "back")
        while True:
            more = within.join(frontier.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            frontier = materialize(more.join(back, ["node", "colour"], "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            back = materialize(back.unionByName(frontier), "back")
        sized = back.join(back.groupBy("colour").agg(F.count(F.lit(1)).alias("size")), "colour")
        loops = pairs.where("a = b").select(F.col("a").alias("node")).withColumn("loop", F.lit(True))
        cycles = sized.join(loops, "node", "left").where("size > 1 or loop").select("node", F.col("colour").alias("component"))
        found = materialize(cycles if found is None else found.unionByName(cycles), "components")
        gone = back.select("node")
        pairs = materialize(pairs.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"), "pairs")
        n = pairs.count()
    return found if found is not None else pairs.toDF("node", "component")


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): the largest number of edges of a path that ends in the node. ``nodes`` (node) defaults to the edges' ends.

    Rounds take away the nodes that no remaining edge ends in, and their edges; the rest, on or behind a cycle, has no level.
    """
    left = materialize(edges.select(F.col("job").alias("a"), F.col("dependent_job").alias("b")).distinct(), "pairs")
    every = left.select(F.col("a").alias("node")).unionByName(left.select("b").toDF("node")).distinct() if nodes is None else nodes.select("node").distinct()
    every = every.hint("merge")
    waiting = every.join(left.select(F.col("b").alias("node")), "node", "left_semi")
    ready = materialize(every.join(left.select(F.col("b").alias("node")), "node", "left_anti"), "ready")
    found, level = [ready.withColumn("level", F.lit(0))], 0
    while True:
        level += 1
        gone = ready.select(F.col("node").alias("a"))
        touched = left.join(gone, "a", "left_semi").select(F.col("b").alias("node")).distinct()
        left = materialize(left.join(gone, "a", "left_anti"), "pairs")
        ready = materialize(touched.join(left.select(F.col("b").alias("node")), "node", "left_anti"), "ready")
        if ready.isEmpty():
            break
        found.append(ready.withColumn("level", F.lit(level)))
        if len(found) > ROUNDS:
            found = [materialize(union_of(found), "levels")]
    stuck = waiting.join(union_of(found).hint("merge"), "node", "left_anti").withColumn("level", F.lit(None).cast("int")) if not left.isEmpty() else None
    return union_of(found if stuck is None else [*found, stuck]).select("node", F.col("level").cast("int").alias("level"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def execution_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rpt, node, step): a topological order of each report: by level, the deepest first, then by category rank and id.

    ``nodes`` has (rpt, node, depth, rank), ``edges`` (rpt, source, target). Nodes on or behind cycles come last. Steps are
    numbered by a range sort of all reports, so a report of any size is spread over many tasks.
    """
    key = lambda c: F.concat_ws("|", "rpt", F.col(c).cast("string"))
    known = nodes.groupBy("rpt", "node").agg(F.min("depth").alias("depth"), F.min("rank").alias("rank")).withColumn("key", key("node"))
    levels = topological_levels(edges.select(key("source").alias("job"), key("target").alias("dependent_job")), known.select(F.col("key").alias("node")))
    ranked = known.join(levels.toDF("key", "level").hint("merge"), "key")
    order = [F.asc_nulls_last("level"), F.desc("depth"), F.asc("rank"), F.asc("node")]
    return numbered(ranked, "rpt", order, "step").select("rpt", "node", "step")
