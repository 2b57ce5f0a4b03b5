"""Branches of dispatchers by the depth of their IFs, and texts cut into parts of a bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scratch import materialize

from .scripts import CHANGE, without_comments

# Fixed values of the rules: the form of a dispatcher's test, and the sizes of parts in characters.
DISPATCH = r"(?i)IF\s+UPPER\s*\(\s*TRIM\s*\(\s*(\w+)\s*\)\s*\)\s+like\s+'%([^%']+)%'"
MOST_CHARS, PART_CHARS, ROOM = 10_000, 9_500, 50


@F.pandas_udf("string")
def uncommented(bodies: pd.Series) -> pd.Series:
    return bodies.map(without_comments)


def dispatch_branches(scripts: DataFrame) -> DataFrame:
    """(script, branch, first_line, last_line, body, n_changes) of (script, body): what stands between a dispatcher's test and its END IF.

    Lines are numbered from 0 in the text without comments. The depth is a running count of IFs less END IFs by line. A line
    that lowers it closes the levels between; the END IF of a test is the next line that closes the level below the test's
    own, found by equality of levels instead of comparing lines with each other. Tests inside a branch, or on the line
    that ends one, belong to it. A branch that is never closed goes to the end of the script; its last line counts as its end.

    Defined results: a null body has no lines; branches without text are left out; repeated scripts must be told by ``script``.
    """
    clean = scripts.select("script", uncommented(F.coalesce("body", F.lit(""))).alias("body"))
    split = F.split("body", "\n")
    split = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    lines = clean.select("script", F.posexplode(split).alias("line", "text"))
    upper = F.upper("text")
    closes = F.regexp_count(upper, F.lit(r"\bEND\s+IF\b"))
    opens = F.regexp_count(F.regexp_replace(upper, r"\bEND\s+IF\b", ""), F.lit(r"\bIF\b"))
    order = Window.partitionBy("script").orderBy("line")
    depth = F.sum(opens - closes).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("depth", depth).withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    lines = materialize(lines.withColumn("branch", F.upper(F.trim(F.regexp_extract("text", DISPATCH, 2)))), "script-lines")
    tests = lines.where(F.col("text").rlike(DISPATCH)).select("script", (F.col("depth") - 1).alias("level"), "line", "branch")
    ends = lines.where("depth < before").select("script", F.explode(F.sequence("depth", F.col("before") - 1)).alias("level"), "line", F.lit(None).cast("string").alias("branch"))
    following = Window.partitionBy("script", "level").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    closed = tests.unionByName(ends).withColumn("end", F.first(F.when(F.col("branch").isNull(), F.col("line")), ignorenulls=True).over(following)).where("branch is not null")
    last = lines.groupBy("script").agg(F.max("line").alias("last"))
    spans = closed.join(last, "script").select("script", F.struct(F.col("line").alias("first"), F.coalesce("end", "last").alias("end"), "branch").alias("span"))
    sorted_spans = spans.groupBy("script").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    kind = "array<struct<first:int,end:int,branch:string>>"
    outer = F.aggregate("spans", F.array().cast(kind), lambda kept, s: F.when((F.size(kept) == 0) | (s["first"] > F.element_at(kept, -1)["end"]), F.concat(kept, F.array(s))).otherwise(kept))
    found = sorted_spans.select("script", F.explode(outer).alias("s")).select("script", "s.branch", F.col("s.first").alias("first_line"), F.col("s.end").alias("last_line"))
    inside = found.withColumn("line", F.explode(F.when(F.col("last_line") - F.col("first_line") > 1, F.sequence(F.col("first_line") + 1, F.col("last_line") - 1)).otherwise(F.array().cast("array<int>"))))
    bodies = inside.join(lines.select("script", "line", "text"), ["script", "line"]).groupBy("script", "branch", "first_line", "last_line").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"))
    bodies = bodies.select("script", "branch", "first_line", "last_line", F.array_join(F.col("t.text"), "\n").alias("body"))
    return bodies.where(F.trim(F.regexp_replace("body", r"\s", "")) != "").withColumn("n_changes", F.regexp_count("body", F.lit(CHANGE)))


def sized_parts(texts: DataFrame, most: int = MOST_CHARS, size: int = PART_CHARS, room: int = ROOM) -> DataFrame:
    """(script, part, n_parts, n_chars, fits, content) of (script, header, body): texts of more than ``most`` characters in parts.

    A text is cut at empty lines. Segments fill a part until the next would bring it over ``size``; a part only ends behind one
    that ends in a semicolon, so a statement longer than that stays whole and its part doesn't fit. Where a part that began at a
    segment would end depends on that segment alone: on the first prefix sum over its own plus the size, and on the next semicolon.
    The segments at which parts begin are those reached from the first by these jumps, found by doubling the jumps.

    Defined results: a null header or body is empty; a text without segments has no parts; parts count from 1.
    """
    plain = texts.select("script", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("body", F.lit("")).alias("body"))
    total = F.length("header") + F.length("body") + 1
    whole = plain.where((total <= most) & (F.regexp_replace("body", r"\s", "") != ""))
    whole = whole.select("script", F.lit(1).alias("part"), F.lit(1).alias("n_parts"), F.concat_ws("\n", "header", "body").alias("content"))
    stripped = F.filter(F.transform(F.split("body", r"\n\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    segments = plain.where(total > most).select("script", "header", F.posexplode(stripped).alias("at", "segment"))
    order = Window.partitionBy("script").orderBy("at")
    segments = segments.withColumn("n", F.length("segment") + 2).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    semicolon = F.first(F.when(F.col("segment").endswith(";"), F.col("at")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    segments = materialize(segments.withColumn("semicolon", semicolon), "segments")
    # The first prefix sum over a segment's limit: both in one line, sorted by value.
    limit = F.lit(size - room) - F.length("header") + F.col("upto") - F.col("n")
    asked = segments.select("script", limit.alias("v"), F.lit(1).alias("asks"), "at", "semicolon")
    sums = segments.select("script", F.col("upto").alias("v"), F.lit(0).alias("asks"), "at", F.lit(None).cast("int").alias("semicolon"))
    ahead = Window.partitionBy("script").orderBy("v", "asks", "at").rowsBetween(1, Window.unboundedFollowing)
    over = asked.unionByName(sums).withColumn("over", F.first(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(ahead)).where("asks = 1")
    jumps = over.where("over is not null and semicolon is not null").select("script", "at", F.greatest(F.col("over"), F.col("at") + 1, F.col("semicolon") + 1).alias("to"))
    jumps = materialize(jumps.join(segments.select("script", F.col("at").alias("to")), ["script", "to"], "left_semi").select("script", "at", "to"), "jumps")
    starts = materialize(segments.where("at = 0").select("script", "at"), "starts")
    while not jumps.isEmpty():
        more = starts.join(jumps, ["script", "at"]).select("script", F.col("to").alias("at"))
        starts = materialize(starts.unionByName(more).distinct(), "starts")
        jumps = materialize(jumps.join(jumps.select("script", F.col("at").alias("to"), F.col("to").alias("far")), ["script", "to"]).select("script", "at", F.col("far").alias("to")), "jumps")
    marked = segments.join(starts.withColumn("begins", F.lit(1)), ["script", "at"], "left")
    numbered = marked.withColumn("part", F.sum(F.coalesce("begins", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = numbered.groupBy("script", "header", "part").agg(F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("s"))
    parts = parts.withColumn("n_parts", F.count(F.lit(1)).over(Window.partitionBy("script")).cast("int"))
    content = F.concat("header", F.lit(" (part "), F.col("part").cast("string"), F.lit("/"), F.col("n_parts").cast("string"), F.lit(")\n\n"), F.array_join("s.segment", "\n\n"))
    found = whole.unionByName(parts.select("script", "part", "n_parts", content.alias("content")))
    return found.select("script", "part", "n_parts", F.length("content").alias("n_chars"), (F.length("content") <= most).alias("fits"), "content")


# What counts as a change for the parser, and forms that it fails on, in the order in which they are looked for.
USABLE = r"(?i)\b(INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|MERGE\s+INTO|UPDATE\s+\w|DELETE\s+(FROM\s+)?\w)\b"
PROBLEMS = (
    (r"(?i)EXECUTE\s+IMMEDIATE\s+\w+\s*\|\|", "dynamic text put together"), (r"(?i)EXECUTE\s+IMMEDIATE\s+\w+\s*;", "dynamic text of a variable"), (r"(?i)SYS\.XMLTYPE\s*\(", "XML type"), (r"(?i)XMLELEMENT\s*\(", "XML element"),
    (r"(?im)^--\s+Lineage:\s+Cursor", "cursor only"),
)
LEAST_LINES = 3


def preflight(texts: DataFrame, dumps: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(object, verdict, reason) of (object, body): whether a cleaned text may go to the parser.

    SKIP where ``dumps`` (object, dump) has a model of it with relationships; REJECT for the first of: too long, without a
    usable change, a form that the parser fails on, fewer than three lines that aren't comments; else PASS. A log behind a dump is
    no part of it. Null bodies are empty.
    """
    model = F.try_parse_json(F.trim(F.element_at(F.split("dump", "\nError log:"), 1)))
    related = F.schema_of_variant(F.try_variant_get(model, "$.relationships", "variant"))
    usable = F.try_variant_get(model, "$.relationships[0]", "variant").isNotNull() & related.startswith("ARRAY")
    done = dumps.where(usable).select("object", F.lit(True).alias("done")).distinct()
    body = F.coalesce("body", F.lit(""))
    code = F.size(F.filter(F.split(body, "\n"), lambda l: (F.regexp_replace(l, r"\s", "") != "") & ~F.regexp_replace(l, r"^\s+", "").startswith("--")))
    reason = F.when(F.col("done"), "done").when(F.length(body) > most, "too long").when(~body.rlike(USABLE), "no change")
    for pattern, name in PROBLEMS:
        reason = reason.when(body.rlike(pattern), name)
    reason = reason.when(code < LEAST_LINES, "empty").otherwise("has changes")
    verdict = F.when(F.col("reason") == "done", "SKIP").when(F.col("reason") == "has changes", "PASS").otherwise("REJECT")
    return texts.join(done, "object", "left").select("object", reason.alias("reason")).withColumn("verdict", verdict)
