"""Lineage fusion: precedence merges, ordered back-fill, key cascades, borrowings and expansions.

Positions (``pos``) are explicit columns, so "the first row wins" is an aggregate by position and never depends on how rows
are dealt out. Every aggregate combines before the shuffle; hot keys are joined with equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import joined
from loomgraph.functions.scratch import materialize


def latest_edges(log: DataFrame) -> DataFrame:
    """One row per (job, dependent_job): its first row, with cmd and params filled, each by itself, from the first row that has them."""
    given = lambda c: F.trim(F.col(c)) != ""
    back_filled = lambda c: F.min_by(F.when(given(c), F.trim(F.col(c))), F.when(given(c), F.col("pos")))
    first = F.min_by(F.struct("cmd", "params"), F.col("pos"))
    grouped = log.groupBy("job", "dependent_job").agg(F.min("pos").alias("pos"), first.alias("f"), back_filled("cmd").alias("cmd"), back_filled("params").alias("params"))
    keep = lambda c: F.when(F.trim(F.col(f"f.{c}")) != "", F.col(f"f.{c}")).otherwise(F.col(c))
    return grouped.select("job", "dependent_job", "pos", keep("cmd").alias("cmd"), keep("params").alias("params"))


def precedence_merge(primary: DataFrame, supplement: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """All primary rows, and of the supplement the first row of each key that the primary lacks."""
    more = supplement.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in supplement.columns if c not in keys]
    first = more.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("row")).select(*keys, "row.*")
    return primary.withColumn("source", F.lit("primary")).unionByName(first.withColumn("source", F.lit("supplement")), allowMissingColumns=True)


def object_aggregate(lineage: DataFrame) -> DataFrame:
    """Tables and counts by object; parts ("_PARTn") also count for their base object, if that has no rows of its own."""
    key = F.upper("object")
    rows = lineage.withColumn("key", key)
    own = rows.select("key").distinct()
    parts = rows.where(F.col("key").rlike(r"_PART\d+$")).withColumn("key", F.regexp_replace("key", r"_PART\d+$", "")).join(own, "key", "left_anti")
    total = lambda df, rolled: df.groupBy("key").agg(joined(F.collect_set(F.upper("src_table"))).alias("src_tables"), joined(F.collect_set(F.upper("tgt_table"))).alias("tgt_tables"), F.count(F.lit(1)).alias("n_rows")).withColumn("rolled", F.lit(rolled))
    return total(rows, False).unionByName(total(parts, True))


def key_cascade(rows: DataFrame, id_column: str, candidates: Sequence[Column], lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Each row with the lookup's row under the first of its candidate keys that is there; ``priority`` counts from 0."""
    keyed = rows.select(id_column, F.posexplode(F.array(*candidates)).alias("priority", "key")).where("key is not null and key <> ''")
    payload = [c for c in lookup.columns if c != lookup_key]
    hits = keyed.join(lookup.withColumnRenamed(lookup_key, "key"), "key")
    best = hits.groupBy(id_column).agg(F.min_by(F.struct("priority", "key", *payload), "priority").alias("hit"))
    return rows.join(best, id_column, "left").select(*rows.columns, "hit.*")


def override_merge(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key; the first relation's where it has one."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").select(key, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("taken_from"))


def borrow_depth(rows: DataFrame) -> DataFrame:
    """Rows without a depth take that of the first row (by pos) with the same root and target that has one."""
    known = rows.where("depth is not null").groupBy("root", "tgt_table").agg(F.min_by("depth", "pos").alias("borrowed"))
    return rows.join(known, ["root", "tgt_table"], "left").withColumn("filled", F.coalesce("depth", "borrowed")).drop("borrowed")


def expand_views(seeds: DataFrame, definitions: DataFrame) -> DataFrame:
    """(rpt, view, depth): views that the seeds (rpt, view, depth) use and the views these use, one step deeper each.

    ``definitions`` has (view, source). A view that is reached twice keeps its smallest depth.
    """
    known = frontier = materialize(seeds.groupBy("rpt", "view").agg(F.min("depth").alias("depth")), "views")
    names = definitions.select(F.col("view").alias("source")).distinct()
    inner = materialize(definitions.join(names, "source", "left_semi").distinct(), "definitions")
    while True:
        reached = frontier.join(inner, "view").groupBy("rpt", F.col("source").alias("view")).agg((F.min("depth") + 1).alias("new"))
        better = reached.join(known, ["rpt", "view"], "left").where("depth is null or new < depth")
        frontier = materialize(better.select("rpt", "view", F.col("new").cast("int").alias("depth")), "frontier")
        if frontier.isEmpty():
            return known
        known = materialize(known.unionByName(frontier).groupBy("rpt", "view").agg(F.min("depth").alias("depth")), "views")


def paired_columns(rows: DataFrame, sources: str, targets: str) -> DataFrame:
    """One row per position of two delimited lists; a missing source is an empty text."""
    lists = F.arrays_zip(F.split(sources, ",").alias("s"), F.split(targets, ",").alias("t"))
    out = rows.select("*", F.posexplode(lists).alias("at", "pair")).where("pair.t is not null")
    return out.withColumn("source_column", F.coalesce(F.trim("pair.s"), F.lit(""))).withColumn("target_column", F.trim("pair.t")).drop("pair")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Sorted names of the jobs right before and right after each job."""
    name = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    up = edges.groupBy(F.col("job").alias("node")).agg(joined(F.collect_set(name("dependent_job")), " | ").alias("upstream"))
    down = edges.groupBy(F.col("dependent_job").alias("node")).agg(joined(F.collect_set(name("job")), " | ").alias("downstream"))
    return up.join(down, "node", "full").select("node", F.coalesce("upstream", F.lit("")).alias("upstream"), F.coalesce("downstream", F.lit("")).alias("downstream"))


def unquoted(value: Column) -> Column:
    """Without blanks around it, and without one pair of equal quotes around it."""
    v = F.trim(value)
    return F.regexp_replace(v, r"^([\"'])(.*)\1$", "$2")


def first_parameter(params: Column) -> Column:
    """The first word of a job's parameters; null where there is none."""
    word = F.split(F.trim(F.regexp_replace(F.coalesce(params, F.lit("")), r"\s+", " ")), " ")[0]
    return F.nullif(unquoted(word), F.lit(""))


def resolved_name(name: Column, pattern: Column, params: Column) -> Column:
    """The object behind a name that a script takes from its parameters: views and executed packages, and names with a ``$``."""
    given = pattern.isin("MV_REFRESH", "MV_REFRESH_WITH_TRUNCATE", "EXECUTE_IMMEDIATE_DYNAMIC") | F.contains(name, F.lit("$"))
    return F.when(given, F.coalesce(first_parameter(params), name)).otherwise(name)


def framework_package(params: Column, default: str) -> Column:
    """The package that a framework's job loads with: its first parameter, else the framework's own."""
    return F.coalesce(first_parameter(params), F.lit(default))


def full_object(package: Column, procedure: Column, params: Column, shell_tables: Column) -> Column:
    """The key of an object: PACKAGE.PROCEDURE, or the one that there is, else the first table that the script names.

    A procedure that is a placeholder (V_..., $..., or in brackets) stands for the first parameter, or itself without
    parameters; DBMS_MVIEW is no package.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    pkg, proc = F.when(F.upper(text(package)) == "DBMS_MVIEW", "").otherwise(text(package)), text(procedure)
    placeholder = F.upper(proc).startswith("V_") | proc.startswith("$") | proc.startswith("(")
    tables = F.trim(F.split(text(shell_tables), ",")[0])
    return F.when(placeholder, F.coalesce(first_parameter(params), proc)).when((pkg != "") & (proc != ""), F.concat(pkg, F.lit("."), proc)).when(pkg != "", pkg).when(proc != "", proc).otherwise(tables)
