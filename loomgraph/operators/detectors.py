"""Detectors by name, under one schema of recommendations, each run on its own so that one failure doesn't end the others.

    @detector("C", "similar jobs")
    def similar(ctx): ...            # ctx["writes"], ctx["lineage"]: relations by name; returns recommendation columns

``run`` writes each detector's rows into the shared folder and reads them back, so a failure while rows are computed is seen there
and told in the report, and the findings of the rest stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import joined
from loomgraph.functions.scratch import materialize

from .detect import is_log_table, similar_clusters
from .matching import finding_recommendations, misnamed_views
from .recommendations import chain_recommendations, load_recommendations, update_recommendations, view_recommendations

#: The columns of a recommendation; what a detector leaves out is null.
SCHEMA = {"category": "string", "target_table": "string", "description": "string", "affected_jobs": "string", "current_hops": "long", "savings": "long", "risk": "string", "recommendation": "string"}
Context = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Detector:
    letter: str
    name: str
    find: Callable[[Context], DataFrame]


@dataclass
class Registry:
    """Detectors in the order in which they were registered; a letter names one only."""

    known: dict[str, Detector] = field(default_factory=dict)

    def detector(self, letter: str, name: str) -> Callable:
        def put(find: Callable[[Context], DataFrame]) -> Callable:
            if letter in self.known:
                raise ValueError(f"detector {letter} is registered already")
            self.known[letter] = Detector(letter, name, find)
            return find

        return put

    def run(self, spark: SparkSession, ctx: Context, only: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Findings (detector, place, and the columns of ``SCHEMA``), and a report (detector, name, place, status, error, n).

        A detector fails if it raises, lacks all of the columns, or its rows can't be computed; it then has no findings at all.
        """
        wanted = list(self.known if only is None else only)
        if unknown := [x for x in wanted if x not in self.known]:
            raise KeyError(f"no detectors {', '.join(unknown)}")
        found, report = [], []
        for place, letter in enumerate(wanted):
            one = self.known[letter]
            try:
                rows = conformed(one.find(ctx)).select(F.lit(letter).alias("detector"), F.lit(place).alias("place"), *SCHEMA)
                rows = materialize(rows, f"detector-{place}")
                found.append(rows)
                report.append((letter, one.name, place, "OK", None, rows.count()))
            except Exception as error:  # whatever a detector raises is its own failure
                report.append((letter, one.name, place, "FAILED", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500], 0))
        types = ", ".join(f"{c} {t}" for c, t in SCHEMA.items())
        rows = spark.createDataFrame([], f"detector string, place int, {types}")
        for more in found:
            rows = rows.unionByName(more)
        return rows, spark.createDataFrame(report, "detector string, name string, place int, status string, error string, n long")


def conformed(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``SCHEMA``; at least one of them must be there."""
    if not set(rows.columns) & set(SCHEMA):
        raise ValueError(f"a detector's rows need some of the columns {', '.join(SCHEMA)}")
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()])


DETECTORS = Registry()
detector = DETECTORS.detector


def job_name() -> Column:
    return F.lpad(F.col("job").cast("string"), 9, "0")


@detector("A", "several loads of a target")
def several_loads(ctx: Context) -> DataFrame:
    """``loads`` (tbl, job, params, is_view), ``objects`` (job, object, is_parameterised)."""
    return load_recommendations(ctx["loads"], ctx["objects"])


@detector("B1", "updates in place")
def in_place(ctx: Context) -> DataFrame:
    """``in_place_reads`` and ``in_place_writes`` (job, tbl)."""
    return update_recommendations(ctx["in_place_reads"], ctx["in_place_writes"])


@detector("C", "similar jobs")
def similar(ctx: Context) -> DataFrame:
    """Jobs that load a target with nearly the same columns, by clusters; log tables are left out.

    ``lineage`` (tgt_table, job, tgt_col, pos), ``offset_jobs`` (job): those whose names say OFFSET; ``parameterised`` (job).
    """
    clusters = similar_clusters(ctx["lineage"].where(~is_log_table(F.col("tgt_table"))))
    marked = clusters.join(ctx["offset_jobs"].select("job", F.lit(True).alias("offset")).distinct(), "job", "left").join(ctx["parameterised"].select("job", F.lit(True).alias("given")).distinct(), "job", "left")
    by = marked.groupBy("tgt_table", "cluster").agg(F.count(F.lit(1)).alias("n"), joined(F.collect_set(job_name())).alias("affected_jobs"), F.max(F.coalesce("offset", F.lit(False))).alias("offset"), F.max(F.coalesce("given", F.lit(False))).alias("given"))
    label = F.when(F.col("offset") & F.col("given"), "C. OFFSET / Near-Duplicate Procedures (Parameterized)").when(F.col("offset"), "C. OFFSET / Near-Duplicate Procedures").otherwise("C. Near-Duplicate Procedures")
    described = F.concat(F.col("n").cast("string"), F.lit(" jobs load '"), F.col("tgt_table"), F.lit("' with >=85% identical target column sets."))
    advice = "Consolidate into single parameterized procedure that accepts partition / offset key as a parameter."
    return by.select(label.alias("category"), F.col("tgt_table").alias("target_table"), described.alias("description"), "affected_jobs", F.col("n").alias("current_hops"), (F.col("n") - 1).alias("savings"), F.lit("LOW").alias("risk"), F.lit(advice).alias("recommendation"))


@detector("D", "serial chains")
def chains(ctx: Context) -> DataFrame:
    """``chain_edges`` (job, dependent_job), ``chain_jobs`` (job, category, depth, has_object), ``chain_writes`` (job, tbl, col)."""
    return chain_recommendations(ctx["chain_edges"], ctx["chain_jobs"], ctx["chain_writes"])


@detector("E2", "views with one consumer")
def single_consumers(ctx: Context) -> DataFrame:
    """``mv_jobs`` (job), ``reads`` and ``writes`` (job, tbl), ``written`` and ``consumed`` (job, tbl, col)."""
    return view_recommendations(ctx["mv_jobs"], ctx["reads"], ctx["writes"], ctx["written"], ctx["consumed"])


@detector("F", "findings of summaries")
def findings(ctx: Context) -> DataFrame:
    """``findings`` (pos, script, finding), ``scripts`` (script), ``sql_objects`` (job, name), ``targets`` (job, tbl, pos)."""
    found = finding_recommendations(ctx["findings"], ctx["scripts"], ctx["sql_objects"], ctx["targets"])
    return found.select(F.lit("F. LLM-Identified Issues").alias("category"), F.col("script").alias("target_table"), "description", F.col("jobs").alias("affected_jobs"), F.lit(0).alias("current_hops"), "savings", "risk", "recommendation")


@detector("O-b", "names of views")
def view_names(ctx: Context) -> DataFrame:
    """``views`` (view), ``view_rows`` (src_table, package, object), ``dependencies`` (script, summary)."""
    found = misnamed_views(ctx["views"], ctx["view_rows"], ctx["dependencies"])
    advice = F.concat(F.lit("RENAME '"), F.col("view"), F.lit("' to '"), F.col("suggestion"), F.lit("' and update: "), F.when(F.col("scripts") == "", "no scripts identified").otherwise(F.col("scripts")))
    return found.select(F.lit("O. View Naming Convention Violation").alias("category"), F.col("view").alias("target_table"), F.concat(F.lit("View '"), F.col("view"), F.lit("' ends in '_VW' rather than starting with 'VW_'.")).alias("description"), F.lit(0).alias("current_hops"), F.lit(0).alias("savings"), F.lit("LOW").alias("risk"), advice.alias("recommendation"))
