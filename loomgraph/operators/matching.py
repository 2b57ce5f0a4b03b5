"""Which of many names stand inside which of many texts, without comparing each with each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import any_of, joined
from loomgraph.functions.scratch import materialize
from loomgraph.functions.variants import exploded

#: Characters of all patterns together up to which one automaton is sent to the tasks.
AUTOMATON_CHARS = 4_000_000
GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def substring_pairs(texts: DataFrame, patterns: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(text, pattern), each pair once: the patterns that stand anywhere in a text.

    ``texts`` has text, ``patterns`` has pattern; nulls and empty ones match nothing. Patterns whose characters were
    counted to be few go to the tasks as one automaton, which reads a text once. More of them are joined: each is keyed by
    the rarest of its substrings of ``GRAM`` characters (a shorter one by itself), texts by all of theirs that are keys, and what
    meets is checked. Both ways give the same rows.
    """
    texts = texts.where("text <> ''").select("text").distinct()
    patterns = materialize(patterns.where("pattern <> ''").select("pattern").distinct(), "patterns")
    chars = patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).head()[0]
    return by_automaton(texts, [r["pattern"] for r in patterns.collect()]) if chars <= automaton_chars else by_grams(texts, patterns)


def by_automaton(texts: DataFrame, patterns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in patterns:
            found.add_word(p, p)
        found.make_automaton()
        for batch in batches:
            pairs = [(t, p) for t in batch.column(0).to_pylist() for p in sorted({p for _, p in found.iter(t)})] if patterns else []
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string())], names=["text", "pattern"])

    return texts.mapInArrow(run, "text string, pattern string")


def by_grams(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    size = F.least(F.length("pattern"), F.lit(GRAM))
    own = F.when(size == 1, grams(F.col("pattern"), 1)).when(size == 2, grams(F.col("pattern"), 2)).otherwise(grams(F.col("pattern"), GRAM))
    of_patterns = patterns.select("pattern", F.explode(own).alias("gram"))
    wanted = of_patterns.select("gram").distinct()
    every = F.concat(*[grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    of_texts = materialize(texts.select("text", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"), "grams")
    often = of_texts.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # A pattern with a substring that no text has can't match; the join would drop that substring, so they are counted.
    known = of_patterns.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.count_if(F.col("often").isNull()).alias("missing"))
    return of_texts.join(known.where("missing = 0"), "gram").where(F.col("text").contains(F.col("pattern"))).select("text", "pattern")


# Fixed values of the rule: words that tell a finding's class (the first class that has one counts), and the texts built below.
REDUNDANCY_WORDS = ("redundant", "duplicate", "repeated", "unnecessary", "remove")
LOGIC_WORDS = ("bug", "error", "incorrect", "wrong", "missing", "mismatch")
PERFORMANCE_WORDS = ("performance", "slow", "full scan", "index", "parallel", "bulk")


def base_name(script: Column) -> Column:
    return F.upper(F.replace(F.replace(script, F.lit(".sql"), F.lit("")), F.lit(".txt"), F.lit("")))


def script_jobs(scripts: DataFrame, sql_objects: DataFrame, targets: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(script, how, job): the jobs that a script means, by the first way that finds any.

    EXACT: its base name is an SQL object of theirs; PARTIAL: one of the two names stands inside the other; TARGET: a table that
    they write stands in it, the table with the smallest pos. ``scripts`` has script, ``sql_objects`` (job, name),
    ``targets`` (job, tbl, pos). A script without any has no row.
    """
    bases = scripts.select("script", base_name(F.col("script")).alias("base")).distinct()
    objects = materialize(sql_objects.where("name <> ''").select("job", F.upper("name").alias("name")).distinct(), "sql-objects")
    exact = bases.join(objects, F.col("base") == F.col("name")).select("script", F.lit("EXACT").alias("how"), "job")
    rest = materialize(bases.join(exact.select("script").distinct(), "script", "left_anti"), "scripts")
    names, left = objects.select("name").distinct(), rest.select("base").distinct()
    inside = substring_pairs(left.toDF("text"), names.toDF("pattern"), automaton_chars).toDF("base", "name")
    around = substring_pairs(names.toDF("text"), left.toDF("pattern"), automaton_chars).toDF("name", "base").select("base", "name")
    partial = rest.join(inside.unionByName(around).distinct(), "base").join(objects, "name").select("script", F.lit("PARTIAL").alias("how"), "job").distinct()
    last = materialize(rest.join(partial.select("script").distinct(), "script", "left_anti"), "scripts")
    tables = targets.where("tbl <> ''").groupBy(F.upper("tbl").alias("tbl")).agg(F.min("pos").alias("pos"))
    met = substring_pairs(last.select(F.col("base").alias("text")), tables.select(F.col("tbl").alias("pattern")), automaton_chars).toDF("base", "tbl")
    first = met.join(tables, "tbl").groupBy("base").agg(F.min_by("tbl", F.struct("pos", "tbl")).alias("tbl"))
    by_target = last.join(first, "base").join(targets.select("job", F.upper("tbl").alias("tbl")).distinct(), "tbl").select("script", F.lit("TARGET").alias("how"), "job")
    return exact.unionByName(partial).unionByName(by_target)


def finding_recommendations(findings: DataFrame, scripts: DataFrame, sql_objects: DataFrame, targets: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One recommendation for each script of the findings (pos, script, finding as JSON text): its jobs, counts by class, risk and texts."""
    jobs = script_jobs(scripts, sql_objects, targets, automaton_chars).groupBy("script").agg(F.first("how").alias("how"), joined(F.collect_set(F.lpad(F.col("job").cast("string"), 9, "0"))).alias("jobs"))
    lower = F.lower("finding")
    has = lambda words: any_of([lower.contains(w) for w in words])
    kind = F.when(has(REDUNDANCY_WORDS), "redundancy").when(has(LOGIC_WORDS), "logic").when(has(PERFORMANCE_WORDS), "performance").otherwise("other")
    counted = findings.withColumn("kind", kind).groupBy("script").agg(F.count(F.lit(1)).alias("n_findings"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("redundancy", "logic", "performance", "other")])
    n = F.col
    issues = F.concat_ws(", ", *[F.when(n(c) > 0, F.concat(n(c).cast("string"), F.lit(f" {label}"))) for c, label in (("n_redundancy", "redundancy signals"), ("n_logic", "logic risks"), ("n_performance", "perf concerns"), ("n_other", "other findings"))])
    concern = F.when(n("n_redundancy") > 0, "redundancy removal").when(n("n_performance") > 0, "performance tuning").when(n("n_logic") > 0, "bug fixes").otherwise("general cleanup")
    risk = F.when(n("n_logic") > 2, "HIGH").when(n("n_performance") > 2, "MEDIUM").otherwise("LOW")
    described = F.concat(F.lit("Script '"), n("script"), F.lit("' has "), n("n_findings").cast("string"), F.lit(" findings: "), issues, F.lit("."))
    advice = F.concat(F.lit("Review script for optimization opportunities. Top concern: "), concern, F.lit("."))
    out = counted.join(jobs, "script", "left").withColumn("how", F.coalesce("how", F.lit("UNMAPPED"))).withColumn("jobs", F.coalesce("jobs", F.lit("UNMAPPED")))
    return out.select("script", "how", "jobs", "n_findings", "n_redundancy", "n_logic", "n_performance", "n_other", risk.alias("risk"), n("n_redundancy").alias("savings"), described.alias("description"), advice.alias("recommendation"))


VIEW_PREFIX, VIEW_SUFFIX = "VW_", "_VW"


def misnamed_views(views: DataFrame, lineage: DataFrame, summaries: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(view, suggestion, scripts, n_scripts): views named by a suffix instead of the prefix, and the scripts that mention them.

    ``views`` has view, ``lineage`` (src_table, package, object), ``summaries`` (script, summary as JSON). Mentions are any
    source table, of the lineage or of the summary's dependencies, with the view's name in it, in either case.
    """
    odd = views.select(F.upper("view").alias("view")).where(F.col("view").endswith(VIEW_SUFFIX) & ~F.col("view").startswith(VIEW_PREFIX)).distinct()
    odd = materialize(odd, "views")
    sources = lineage.select(F.upper("src_table").alias("text"), F.explode(F.array(F.trim("package"), F.trim("object"))).alias("name")).where("name <> ''")
    named = sources.where(~F.upper("name").startswith("VIEW_")).withColumn("script", F.when(F.col("name").contains("."), F.col("name")).otherwise(F.concat("name", F.lit(".sql"))))
    tables = F.try_variant_get(F.try_parse_json("summary"), "$.INPUT_DEPENDENCIES.source_tables", "variant")
    steps = F.try_variant_get(F.try_parse_json("summary"), "$.INPUT_DEPENDENCIES.procedure_level_dependencies", "variant")
    lists = exploded(exploded(summaries.select("script", F.explode(F.array(tables, steps)).alias("group")), "group", "list"), "list", "entry")
    told = lists.where("list_is_array and list_key is not null").select("script", F.upper(F.try_variant_get("entry", "$", "string")).alias("text"), F.lit(None).cast("string").alias("name"))
    mentions = materialize(named.select("text", "name", "script").unionByName(told.select("text", "name", "script")).distinct(), "mentions")
    pairs = substring_pairs(mentions.select("text"), odd.select(F.col("view").alias("pattern")), automaton_chars)
    met = mentions.join(pairs, "text").withColumnRenamed("pattern", "view").where(F.when(F.col("name").isNull(), F.upper("script") != F.concat("view", F.lit(".SQL"))).otherwise(F.col("name") != F.col("view")))
    by_view = met.groupBy("view").agg(joined(F.collect_set("script")).alias("scripts"), F.count_distinct("script").alias("n_scripts"))
    suggestion = F.concat(F.lit(VIEW_PREFIX), F.ltrim(F.replace("view", F.lit(VIEW_SUFFIX), F.lit("")), F.lit("_")))
    return odd.join(by_view, "view", "left").select("view", suggestion.alias("suggestion"), F.coalesce("scripts", F.lit("")).alias("scripts"), F.coalesce("n_scripts", F.lit(0).cast("long")).alias("n_scripts"))
