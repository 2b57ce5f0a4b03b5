"""Relations out of package bodies, line by line.

``packages`` has (script, body). A body is a relation of its lines, with running states by windows over one script: which
lines stand in a block comment, which procedure they belong to, how many blocks are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import ladder

# Fixed values of the analysed packages.
UTILITY_PROCEDURES = ("PRC_REBUILD_INDEXES", "PRC_TRUNC_PARTITION", "PRC_DEBUG_TRACE", "PRC_DEBUG_EXEC_TIME")
UTILITY_PREFIXES = ("PKG_GRP_LOG_UTIL", "PKG_LOG_ERROR_UTILITY", "PKG_GRP_COMMON_UTIL", "DBMS_STATS", "DBMS_MVIEW", "DBMS_OUTPUT", "DBMS_UTILITY", "UTL_FILE", "SYS.", "STANDARD.")
CALL_ROOTS = ("PKG_", "PRC_", "PROC_", "DBMS_", "UTL_", "SYS", "STANDARD")

DECLARED = r"(?i)^\s*PROCEDURE\s+(\w+)"
DML = r"(?i)\b(INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|UPDATE\s+\w+|DELETE\s+FROM|MERGE\s+INTO)\b"


def code_lines(packages: DataFrame) -> DataFrame:
    """(script, line, text, in_block, commented): lines from 1; a line that ends a block comment has ``in_block`` null.

    A line that opens a comment which it does not close begins a block; the next line with a closing mark ends it.
    """
    lines = packages.select("script", F.posexplode(F.split("body", "\n")).alias("at", "text"))
    opens, closes = F.col("text").contains("/*"), F.col("text").contains("*/")
    mark = F.when(closes, F.lit(False)).when(opens, F.lit(True))
    order = Window.partitionBy("script").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(False))
    marked = lines.select("script", (F.col("at") + 1).alias("line"), "text", F.when(~closes, state).alias("in_block"))
    return marked.withColumn("commented", F.coalesce("in_block", F.lit(False)) | F.ltrim("text").startswith("--"))


def listed_procedures(packages: DataFrame) -> DataFrame:
    """(script, line, procedure, commented): declarations, with whether they stand in a comment."""
    found = code_lines(packages).where(F.col("in_block").isNotNull()).select("script", "line", F.upper(F.regexp_extract("text", DECLARED, 1)).alias("procedure"), "commented")
    return found.where("procedure <> ''")


def call_kind(called: Column) -> Column:
    utility = F.lit(False)
    for p in UTILITY_PREFIXES:
        utility = utility | called.startswith(p)
    standalone = called.startswith("PRC_") | called.startswith("PROC_")
    return ladder([(utility, "Utility / Logging"), (called.startswith("PKG_"), "Cross-Package (Functional)"), (standalone, "Cross-PROC (Standalone)")], "Other")


def external_calls(packages: DataFrame, own: str = "name") -> DataFrame:
    """(script, called, kind, first_line, n, commented): dotted calls of other packages.

    A name counts as commented only if all of its occurrences are; ``own`` names the column of the package's own name.
    """
    lines = code_lines(packages).where(F.col("in_block").isNotNull())
    calls = lines.select("script", "line", "commented", "text", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+(?:\.\w+)+)\s*[;(]"), F.lit(1))).alias("raw")).withColumn("called", F.upper("raw"))
    root = F.split("called", r"\.")[0]
    wanted = F.lit(False)
    for r in CALL_ROOTS:
        wanted = wanted | root.startswith(r)
    defined = F.upper("text").rlike(r"CREATE\s+(OR\s+REPLACE\s+)?(EDITIONABLE\s+)?(PROCEDURE|FUNCTION)\s")
    mine = packages.select("script", F.upper(own).alias("own"))
    calls = calls.where(wanted & ~defined).join(mine, "script").where((F.col("called") != F.col("own")) & ~F.col("called").startswith(F.concat("own", F.lit("."))))
    by = calls.groupBy("script", "called").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n"), F.bool_and("commented").alias("commented"))
    return by.select("script", "called", call_kind(F.col("called")).alias("kind"), "first_line", "n", "commented")


def segments(packages: DataFrame) -> DataFrame:
    """Lines from each declaration to the next, with ``start`` (its line) and ``procedure``; commented declarations begin one too."""
    lines = code_lines(packages)
    name = F.upper(F.regexp_extract("text", DECLARED, 1))
    order = Window.partitionBy("script").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("declared", F.when(name != "", F.struct("line", name.alias("name"), "commented")))
    lines = lines.withColumn("d", F.last("declared", ignorenulls=True).over(order)).where("d is not null")
    return lines.select("script", "line", "text", "in_block", "commented", F.col("d.line").alias("start"), F.col("d.name").alias("procedure"), F.col("d.commented").alias("gone"))


def main_calls(packages: DataFrame) -> DataFrame:
    """(script, place, procedure, line): procedures that the last MAIN names, in the order of their first places."""
    listed = listed_procedures(packages)
    names = listed.where("procedure <> 'MAIN'").select("script", "procedure").distinct()
    every = segments(packages)
    last = every.where("procedure = 'MAIN'").groupBy("script").agg(F.max("start").alias("start"))
    body = every.join(last, ["script", "start"]).where(~F.ltrim("text").startswith("--") & ~F.col("text").rlike(DECLARED))
    words = body.select("script", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"(\w+)"), F.lit(1)))).alias("procedure"), "text")
    first = words.join(names, ["script", "procedure"]).groupBy("script", "procedure").agg(F.min(F.struct("line", F.expr("instr(upper(text), procedure)"))).alias("at"))
    place = F.row_number().over(Window.partitionBy("script").orderBy("at", "procedure")).cast("long")
    return first.select("script", place.alias("place"), "procedure", F.col("at.line").alias("line"))


def package_parts(packages: DataFrame) -> DataFrame:
    """(script, procedure, first_line, last_line, status): what becomes of each procedure when a package is split.

    A procedure ends at its own END name, else where its blocks are closed (BEGIN opens one, END; at a line's start closes
    one), else before the next declaration, or for the last one before the package's own end. Commented ones, utilities
    and a MAIN that calls others are not taken out; such a MAIN with changes of its own is HYBRID.
    """
    lines = segments(packages)
    upper = F.upper(F.trim("text"))
    seen = F.col("in_block").isNotNull() & ~F.col("commented")
    whole = Window.partitionBy("script", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(seen & upper.rlike(r"\bBEGIN\b"), 1).otherwise(0)
    ends = F.when(seen & upper.rlike(r"^END\s*;"), 1).otherwise(0)
    counted = lines.withColumn("opened", F.sum(begins).over(whole)).withColumn("depth", F.col("opened") - F.sum(ends).over(whole))
    named = seen & upper.rlike(r"^END\s+\w+\s*;") & (F.regexp_extract(upper, r"^END\s+(\w+)\s*;", 1) == F.col("procedure"))
    closed = (ends == 1) & (F.col("opened") > 0) & (F.col("depth") <= 0)
    outer = F.when(upper.rlike(r"^END\s+\w+\s*;"), F.col("line"))
    by = counted.groupBy("script", "start", "procedure", "gone").agg(
        F.min(F.when(named | closed, F.col("line"))).alias("end"), F.max("line").alias("most"), F.max(outer).alias("outer"),
        F.max(F.col("line")).alias("stop"),
    )
    final = F.max("start").over(Window.partitionBy("script"))
    fallback = F.when(F.col("start") == final, F.coalesce(F.when(F.col("outer") > F.col("start"), F.col("outer") - 1), F.col("most"))).otherwise(F.col("most"))
    by = by.withColumn("last_line", F.coalesce("end", fallback))
    body = counted.join(by.select("script", "start", "last_line"), ["script", "start"]).where(F.col("line") <= F.col("last_line"))
    changes = body.groupBy("script", "start").agg(F.bool_or(F.col("text").rlike(r"(?i)\b(INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|MERGE\s+INTO|UPDATE\s+\w)")).alias("changes"))
    others = by.where(~F.col("gone") & ~F.col("procedure").isin("MAIN", *UTILITY_PROCEDURES)).select("script").distinct().withColumn("others", F.lit(True))
    by = by.join(changes, ["script", "start"], "left").join(others, "script", "left")
    main = (F.col("procedure") == "MAIN") & F.coalesce("others", F.lit(False))
    status = ladder([(F.col("gone"), "COMMENTED"), (F.col("procedure").isin(*UTILITY_PROCEDURES), "UTILITY"), (main & F.col("changes"), "HYBRID_MAIN"), (main, "ORCHESTRATOR_MAIN")], "EXTRACTED")
    return by.select("script", "procedure", F.col("start").alias("first_line"), F.when(~F.col("gone"), F.col("last_line")).alias("last_line"), status.alias("status"))


def concept_branches(packages: DataFrame) -> DataFrame:
    """(script, concept, first_line, last_line, n_changes): branches of a dispatcher on the source concept.

    A branch goes from its IF to the END IF that closes it; ``n_changes`` counts its lines with a changing statement.
    """
    lines = code_lines(packages).where(F.col("in_block").isNotNull() & ~F.col("commented"))
    concept = F.regexp_extract("text", r"(?i)IF\s+LC_SOURCE_CONCEPT\s*=\s*'ALL'\s+OR\s+LC_SOURCE_CONCEPT\s*(?:=|LIKE)\s*'([^']+)'", 1)
    upper = F.upper("text")
    closes = F.regexp_count(upper, F.lit(r"\bEND\s+IF\b"))
    opens = F.regexp_count(F.regexp_replace(upper, r"\bEND\s+IF\b", ""), F.lit(r"\bIF\b"))
    order = Window.partitionBy("script").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    depth = lines.select("script", "line", "text", concept.alias("concept"), F.sum(opens - closes).over(order).alias("depth"))
    starts = depth.where("concept <> ''").select("script", F.col("line").alias("first_line"), F.upper(F.regexp_replace("concept", "%+$|_+$", "")).alias("concept"), F.col("depth").alias("own"))
    after = starts.join(depth.select("script", "line", "depth", "text"), "script").where("line > first_line")
    last = after.where(F.col("depth") < F.col("own")).groupBy("script", "first_line", "concept").agg(F.min("line").alias("last_line"))
    inside = after.join(last.drop("concept"), ["script", "first_line"]).where("line < last_line")
    n = inside.groupBy("script", "first_line").agg(F.count_if(F.col("text").rlike(DML)).alias("n_changes"))
    return last.join(n, ["script", "first_line"], "left").select("script", "concept", "first_line", "last_line", F.coalesce("n_changes", F.lit(0).cast("long")).alias("n_changes"))
