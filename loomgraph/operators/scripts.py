"""Relations out of script texts, by regular expressions over whole texts.

``scripts`` has (script, body). Each extractor returns a row per match with the script it stands in; names are upper-cased.
Patterns are ASCII and stay in Java; only the literal-aware splitters go over their marks in Python, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scratch import materialize

NAME = r"[A-Za-z][A-Za-z0-9_$#.]*"


def groups_of(pattern: str, *groups: str) -> Column:
    """The matches in ``body`` in their order, as structs of the named groups."""
    return F.arrays_zip(*[F.regexp_extract_all("body", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)])


def matches(scripts: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """(script, at, groups...): the groups of each match, ``at`` counting from 0."""
    zipped = scripts.select("script", F.posexplode(groups_of(pattern, *groups)).alias("at", "m"))
    return zipped.select("script", "at", *[F.col(f"m.{g}").alias(g) for g in groups])


def descriptions(scripts: DataFrame) -> DataFrame:
    return scripts.select("script", F.trim(F.regexp_extract("body", r"(?im)^#\s*Description:\s*(.*)$", 1)).alias("description"))


def assignments(scripts: DataFrame) -> DataFrame:
    return matches(scripts, r"(?m)^(TABLE_NAME|MV_NAME|TBL_NAME)=(\S+)$", "variable", "value")


def remote_calls(scripts: DataFrame) -> DataFrame:
    """Scripts that run on another host."""
    found = matches(scripts, r"(?m)\bssh\s+(\S+)\s+(\S+\.sh)", "host", "path")
    return found.select("script", "at", "host", F.regexp_extract("path", r"[^/]+$", 0).alias("remote_script"))


def clean_table(name: Column) -> Column:
    """Upper case, without hints, quotes and schema."""
    bare = F.regexp_replace(F.regexp_replace(name, r"/\*\+?.*?\*/", ""), '["`]', "")
    return F.upper(F.regexp_replace(F.trim(bare), r"^.*\.", ""))


def inserts(scripts: DataFrame) -> DataFrame:
    """Targets of INSERT ... SELECT and their sources, DUAL left out."""
    body = matches(scripts, rf"(?is)\bINSERT\s+INTO\s+({NAME})\s+(SELECT\b.*?);", "target", "query")
    sources = F.regexp_extract_all("query", F.lit(rf"(?i)\b(?:FROM|JOIN)\s+({NAME})"), F.lit(1))
    found = body.select("script", clean_table(F.col("target")).alias("target"), F.explode(sources).alias("source"))
    return found.select("script", "target", clean_table(F.col("source")).alias("source")).where("source <> 'DUAL'").distinct()


def truncates(scripts: DataFrame) -> DataFrame:
    return matches(scripts, rf"(?i)\bTRUNCATE\s+TABLE\s+({NAME})", "table").select("script", clean_table(F.col("table")).alias("tbl"))


def changes(scripts: DataFrame) -> DataFrame:
    """Tables of DELETE and UPDATE statements; hints may stand before the name."""
    deleted = matches(scripts, rf"(?i)\bDELETE\s+(?:/\*.*?\*/\s*)?FROM\s+({NAME})", "table").withColumn("kind", F.lit("DELETE_FROM"))
    updated = matches(scripts, rf"(?i)\bUPDATE\s+(?:/\*.*?\*/\s*)?({NAME})\s+SET\b", "table").withColumn("kind", F.lit("UPDATE_TABLE"))
    return deleted.unionByName(updated).select("script", "kind", clean_table(F.col("table")).alias("tbl"))


def calls(scripts: DataFrame) -> DataFrame:
    """Calls of package.procedure."""
    found = matches(scripts, r"(?i)\bexec\s+([A-Z0-9_]+)\.([A-Z0-9_]+)", "package", "procedure")
    return found.select("script", F.upper("package").alias("package"), F.upper("procedure").alias("procedure"))


def heredocs(scripts: DataFrame) -> DataFrame:
    """SQL blocks between a marker and its end."""
    return matches(scripts, r"(?s)<<(\w+)\n(.*?)\n\1", "marker", "block").select("script", "marker", F.length("block").alias("n_chars"))


def patterns(scripts: DataFrame) -> DataFrame:
    """The kinds of statements of each script, one row each; scripts without any are UNKNOWN if they start a client, else NO_SQL."""
    tag = lambda df, kind: df.select("script", F.lit(kind).alias("pattern"))
    found = tag(remote_calls(scripts), "SSH_REMOTE").unionByName(tag(inserts(scripts), "STATIC_SQL")).unionByName(tag(truncates(scripts), "TRUNCATE_TABLE")).unionByName(changes(scripts).select("script", F.col("kind").alias("pattern"))).unionByName(tag(calls(scripts), "DIRECT_PKG_PROC_CALL")).distinct()
    fallback = F.when(F.coalesce("body", F.lit("")).rlike("(?i)sqlplus"), "UNKNOWN").otherwise("NO_SQL").alias("pattern")
    none = scripts.join(found.select("script").distinct(), "script", "left_anti").select("script", fallback)
    return found.unionByName(none)


def preferred_objects(refs: DataFrame) -> DataFrame:
    """One reference per (script, object): with a schema before without, packages before procedures, then the first."""
    order = F.struct(F.col("schema") == "", F.col("kind") != "PACKAGE", "pos")
    return refs.groupBy("script", "object").agg(F.min_by(F.struct("schema", "kind", "pos"), order).alias("r")).select("script", "object", "r.*")


#: Marks that split or shield text: quoted text (also by q'[...]' and the like), comments, parentheses, semicolons, UNION.
MARK = re.compile(r"""[qQ]'\[.*?\]'|[qQ]'\{.*?\}'|[qQ]'\(.*?\)'|[qQ]'<.*?>'|[qQ]'([^\s\[({<])(?:.*?)\1'|'[^']*(?:'|\Z)|--[^\n]*|/\*|\*/|[();]|\bUNION(?:\s+ALL)?\b""", re.S | re.I)


def without_comments(text: str) -> str:
    """PL/SQL text without comments: -- to the line's end and /* */ in nests; quoted text is left alone."""
    out, at, i = [], 0, 0
    while m := MARK.search(text, i):
        i = m.end()
        if m[0] == "/*":
            out.append(text[at : m.start()])
            depth = 1
            while depth and (n := NEST.search(text, i)):
                depth, i = depth + (1 if n[0] == "/*" else -1), n.end()
            at = i = len(text) if depth else i
        elif m[0].startswith("--"):
            out.append(text[at : m.start()])
            at = i
    return "".join(out) + text[at:]


NEST = re.compile(r"/\*|\*/")


def pieces(text: str, splits: str) -> list[str]:
    """Parts of the text between marks of one kind (";" or "UNION") outside of quotes and parentheses."""
    out, start, depth = [], 0, 0
    for m in MARK.finditer(text):
        mark = m[0]
        if mark in "()":
            depth = max(0, depth + (1 if mark == "(" else -1))
        elif depth == 0 and mark[:5].upper() == splits:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [x for x in [*out, text[start:].strip()] if x]


def statements(text: str) -> list[str]:
    """Statements between semicolons outside of quotes and parentheses."""
    return pieces(text, ";")


def split_statements(scripts: DataFrame) -> DataFrame:
    """(script, at, statement): the statements of each text without its comments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(s, i, x) for s, body in zip(pdf["script"], pdf["body"]) for i, x in enumerate(statements(without_comments(body or "")))]
            yield pd.DataFrame(rows, columns=["script", "at", "statement"])

    return scripts.select("script", "body").mapInPandas(run, "script long, at int, statement string")


def statement_kind(statement: Column) -> Column:
    upper = F.upper(F.trim(statement))
    return (
        F.when(upper.rlike(r"^(INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b"), "DML")
        .when(upper.rlike(r"^CREATE\s+MATERIALIZED\s+VIEW\b"), "MVIEW")
        .when(upper.rlike(r"^CREATE\s+(OR\s+REPLACE\s+)?VIEW\b"), "VIEW")
        .when(upper.rlike(r"^(CREATE\s+(OR\s+REPLACE\s+)?(PACKAGE|PROCEDURE|FUNCTION)|BEGIN|DECLARE)\b"), "PLSQL")
        .when(upper.rlike(r"^(COMMIT|ROLLBACK|EXIT|NULL)\b"), "BOILERPLATE")
        .otherwise("OTHER")
    )


def parameters(scripts: DataFrame) -> DataFrame:
    """Positional parameters ($1, ${2}) of each script, with how often each stands in it."""
    found = matches(scripts, r"\$\{?(\d+)\}?", "position")
    return found.groupBy("script", F.col("position").cast("int").alias("position")).agg(F.count(F.lit(1)).alias("n"))


def view_refreshes(scripts: DataFrame) -> DataFrame:
    """Refreshed materialised views; a variable's value is looked up among the script's assignments."""
    found = matches(scripts, r"(?i)DBMS_MVIEW\.REFRESH\s*\(\s*'?(\$?\w+)'?", "view")
    named = assignments(scripts).groupBy("script", F.concat(F.lit("$"), "variable").alias("view")).agg(F.min_by("value", "at").alias("value"))
    return found.join(named, ["script", "view"], "left").select("script", F.upper(F.coalesce("value", "view")).alias("view"), F.col("view").startswith("$").alias("by_variable"))


def dynamic_statements(scripts: DataFrame) -> DataFrame:
    """EXECUTE IMMEDIATE: with a literal that is all of the statement, or built up; per script a literal suppresses the same built-up object."""
    static = matches(scripts, r"(?i)EXECUTE\s+IMMEDIATE\s+'\s*BEGIN\s+([\w.]+)[^']*'\s*;", "object").withColumn("kind", F.lit("STATIC"))
    built = matches(scripts, r"(?i)EXECUTE\s+IMMEDIATE\s+'\s*BEGIN\s+([\w.]+)[^']*'\s*\|\|", "object").withColumn("kind", F.lit("DYNAMIC"))
    rest = built.join(static.select("script", "object").distinct(), ["script", "object"], "left_anti")
    return static.unionByName(rest).select("script", F.upper("object").alias("object"), "kind").distinct()


def union_branches(query: str) -> list[str]:
    """The branches of a query between UNIONs outside of parentheses and quotes."""
    return pieces(query, "UNION")


def split_unions(queries: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(s, i, x) for s, body in zip(pdf["script"], pdf["body"]) for i, x in enumerate(union_branches(body or ""))]
            yield pd.DataFrame(rows, columns=["script", "at", "branch"])

    return queries.select("script", "body").mapInPandas(run, "script long, at int, branch string")


def chunked(rows: DataFrame, limit: int) -> DataFrame:
    """(script, at, chunk): consecutive statements filled into chunks of at most ``limit`` characters; a longer one stands alone."""
    ordered = rows.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("at", F.length("statement").alias("n")))).alias("s"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.expr("cast(array() as array<struct<at:int,chunk:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = (a["size"] > 0) & (a["size"] + x["n"] > limit)
        chunk = F.when(over, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(over, x["n"]).otherwise(a["size"] + x["n"]).alias("size"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), chunk.alias("chunk")))).alias("out"))

    filled = ordered.select("script", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("c"))
    return filled.select("script", "c.at", "c.chunk")


def without_exceptions(body: Column) -> Column:
    """Exception handlers go, up to the END behind them."""
    return F.regexp_replace(body, r"(?is)\bEXCEPTION\s+WHEN\s+\w+\s+THEN\b.*?(?=\bEND\s+\w+\s*;|\bEND\s*;)", "")


CHANGE = r"(?is)\b(?:INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|UPDATE\s+\w+|DELETE\s+(?:FROM\s+)?\w+|MERGE\s+INTO)\b"
#: Statements without lineage, by their first word (fixed values).
PLAIN = r"(?is)^(?:CREATE\s|PROCEDURE\b|FUNCTION\b|BEGIN\b|END\b|DECLARE\b|IF\b|ELSE\b|ELSIF\b|LOOP\b|FOR\b|COMMIT\b|ROLLBACK\b|EXIT\b|NULL\b|RETURN\b|RAISE\b)"


def cursor_sources(scripts: DataFrame) -> DataFrame:
    """(script, cursor, query, target): selects of named cursors and of OPEN ... FOR.

    A named cursor's target is the first table changed with the cursor's name behind it in the same or the next four
    statements, as in a loop; that of an OPEN is the first table inserted into. Null where there is none.
    """
    # Targets are looked up in the row's own text. As joins, with a row for each word of each script, they were broadcast:
    # the planner takes a text for 20 bytes.
    uses = groups_of(r"(?is)\b(?:UPDATE|INSERT\s+INTO)\s+(\w+)(?=((?:[^;]*;){0,4}[^;]*))", "target", "behind")
    words = lambda text: F.regexp_extract_all(F.upper(text), F.lit(r"(\w+)"), F.lit(1))
    first = F.upper(F.get(F.filter(uses, lambda u: F.array_contains(words(u["behind"]), F.upper("cursor"))), F.lit(0))["target"])
    into = F.upper(F.regexp_extract("body", r"(?is)\bINSERT\s+(?:/\*[^*]*\*/\s*)?INTO\s+(\w+)", 1))
    found = None
    for pattern, target in ((r"(?is)\bCURSOR\s+(\w+)\s*(?:\([^)]*\))?\s*IS\s*(SELECT\b.+?);", first), (r"(?is)\bOPEN\s+(\w+)\s+FOR\s+(SELECT\b.+?);", F.nullif(into, F.lit("")))):
        each = scripts.select("script", "body", F.explode(groups_of(pattern, "cursor", "query")).alias("m")).select("script", "body", "m.*")
        one = each.select("script", F.upper("cursor").alias("cursor"), F.trim("query").alias("query"), target.alias("target"))
        found = one if found is None else found.unionByName(one)
    return found


def dynamic_changes(scripts: DataFrame) -> DataFrame:
    """(script, kind, tbl): changes that are written as texts into a variable which is executed later on."""
    found = matches(scripts, r"(?i)(\w+)\s*:=\s*'(MERGE|INSERT)\s+INTO\s+(\w+)[^']*'\s*;(?=[\s\S]*EXECUTE\s+IMMEDIATE\s+\1)", "variable", "kind", "tbl")
    return found.select("script", F.upper("kind").alias("kind"), F.upper("tbl").alias("tbl"))


def cleaned(scripts: DataFrame) -> DataFrame:
    """(script, part, at, statement): what of a procedure says where data comes from, in the order of the steps.

    Comments go, then exception handlers; a statement with a change counts from that on, whatever stands before it and
    before it is looked at as boilerplate, without its FORALL; executed texts count if they change or create from a
    select. Selects of cursors (part 1) and changes kept in variables (part 2) follow.
    """
    bare = split_statements(scripts).groupBy("script").agg(F.array_sort(F.collect_list(F.struct("at", "statement"))).alias("s"))
    bare = bare.select("script", without_exceptions(F.concat(F.array_join(F.transform("s", lambda x: x["statement"]), ";\n"), F.lit(";"))).alias("body"))
    bare = materialize(bare, "bare-scripts")
    each = split_statements(bare)
    changed = F.col("statement").rlike(CHANGE)
    executed = F.col("statement").rlike(r"(?i)\bEXECUTE\s+IMMEDIATE\b")
    word = F.col("statement").rlike(r"(?i)\b(INSERT|UPDATE|DELETE|MERGE)\b") | F.col("statement").rlike(r"(?is)\bCREATE\s+TABLE\b.*\bAS\s+SELECT\b")
    kept = each.where(F.when(executed & ~F.col("statement").rlike(PLAIN), word).when(executed, F.lit(False)).otherwise(changed))
    from_change = F.when(executed, F.col("statement")).otherwise(F.regexp_extract("statement", f"{CHANGE}.*", 0))
    from_change = F.regexp_replace(from_change, r"(?i)^\s*FORALL\s+\w+\s+IN\s+\w+\.FIRST\s*\.\.\s*\w+\.LAST\s*", "")
    direct = kept.select("script", F.lit(0).alias("part"), "at", F.regexp_replace(from_change, r"(\n[ \t]*)+\n", "\n").alias("statement"))
    cursors = cursor_sources(bare)
    text = F.concat(F.when(F.col("target").isNotNull(), F.concat(F.lit("INSERT INTO "), "target", F.lit(" "))).otherwise(""), "query")
    derived = cursors.groupBy("script").agg(F.array_sort(F.collect_set(text)).alias("q")).select("script", F.lit(1).alias("part"), F.posexplode("q").alias("at", "statement"))
    stored = dynamic_changes(bare).groupBy("script").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", F.lit("INTO"), "tbl"))).alias("q")).select("script", F.lit(2).alias("part"), F.posexplode("q").alias("at", "statement"))
    return direct.unionByName(derived).unionByName(stored)


def variable_positions(scripts: DataFrame) -> DataFrame:
    """(script, variable, position): the parameter that a variable is first set from."""
    found = matches(scripts, r"(\w+)\s*=\s*\$(\d+)", "variable", "number")
    return found.groupBy("script", "variable").agg(F.min_by("number", "at").alias("number")).select("script", "variable", F.concat(F.lit("$"), "number").alias("position"))


BEHIND = r"(?=([\s\S]{0,500}))"


def executed_calls(scripts: DataFrame) -> DataFrame:
    """(script, kind, object_type, schema, object, sub_object, parameterized, position): calls in EXECUTE IMMEDIATE.

    Five forms in order: package by variable, package, procedure, whole literal, procedure by variable. The third and
    fourth give way to an earlier call of the same object, the last to an earlier one of its schema with a sub-object. The
    500 characters behind a call tell its parameters and, in USING, which variables they come from.
    """
    head = r"(?i)EXECUTE\s+IMMEDIATE\s+'begin"
    forms = [
        (1, "DYNAMIC", "PACKAGE", head + r"\s*'\s*\|\|\s*'(\w+)\.'\s*\|\|\s*'\$(\w+)'\s*\|\|\s*'\.(\w+)" + BEHIND),
        (2, "STATIC", "PACKAGE", head + r"\s+(\w+)\.(\w+)'\s*\|\|\s*'\.(\w+)" + BEHIND),
        (3, "STATIC", "PROCEDURE", head + r"\s+(\w+)\.(\w+)'\s*\|\|\s*'\(()" + BEHIND),
        (4, "STATIC", "PACKAGE", head + r"\s+(\w+)\.(\w+)\.(\w+)\s*\([^)]*\)\s*;\s*END\s*;'" + BEHIND),
        (5, "DYNAMIC", "PROCEDURE", head + r"\s*'\s*\|\|\s*'(\w+)\.'\s*\|\|\s*'\$(\w+)'\s*\|\|(?!\s*'\.\w)()" + BEHIND),
    ]
    found = None
    for rank, kind, of, pattern in forms:
        one = matches(scripts, pattern, "schema", "object", "sub_object", "behind").select("script", F.lit(rank).alias("rank"), "at", F.lit(kind).alias("kind"), F.lit(of).alias("object_type"), F.upper("schema").alias("schema"), "object", "sub_object", "behind")
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("object", F.when(F.col("rank").isin(1, 5), F.col("object")).otherwise(F.upper("object"))).withColumn("sub_object", F.when(F.col("rank") == 4, F.upper("sub_object")).otherwise(F.col("sub_object")))
    place = F.struct("rank", "at")
    same, schema = Window.partitionBy("script", "object"), Window.partitionBy("script", "schema")
    earlier = F.min(F.when(~F.col("rank").isin(1, 5), place)).over(same) < place
    shadowed = F.min(F.when(F.col("sub_object") != "", place)).over(schema) < place
    gone = (F.col("rank").isin(3, 4) & F.coalesce(earlier, F.lit(False))) | ((F.col("rank") == 5) & F.coalesce(shadowed, F.lit(False)))
    found = found.withColumn("gone", gone).where("not gone").drop("gone")
    positions = variable_positions(scripts)
    named = found.join(positions.withColumnRenamed("variable", "object"), ["script", "object"], "left")
    using = F.regexp_extract("behind", r"(?is)USING\s+(.*?);", 1)
    used = found.where("rank in (2, 3)").select("script", "rank", "at", F.posexplode(F.regexp_extract_all(using, F.lit(r"(\w+)"), F.lit(1))).alias("n", "variable"))
    listed = used.join(positions, ["script", "variable"]).groupBy("script", "rank", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "position"))), lambda x: x["position"]), ",").alias("listed"))
    out = named.join(listed, ["script", "rank", "at"], "left")
    by_variable = F.col("rank").isin(1, 5)
    return out.select(
        "script", "rank", "kind", "object_type", "schema", F.when(by_variable, F.concat(F.lit("$"), "object")).otherwise(F.col("object")).alias("object"), "sub_object",
        F.when(by_variable, F.lit(True)).when(F.col("rank") == 4, F.lit(False)).otherwise(F.col("behind").rlike(r"\$\{?\w+\}?")).alias("parameterized"),
        F.when(by_variable, F.coalesce("position", F.lit("unknown"))).otherwise(F.coalesce("listed", F.lit(""))).alias("position"),
    )


#: Schemas and names that are no calls of interest (fixed values).
NO_SCHEMAS, NO_NAMES = ("DBMS_UTILITY", "DBMS_OUTPUT", "DBMS_MVIEW", "V_START_TIME"), ("GET_TIME", "PUT_LINE", "LOG_TIME", "REFRESH")


def direct_calls(scripts: DataFrame) -> DataFrame:
    """(script, form, object_type, schema, object, sub_object): calls in the SQL blocks of scripts, one row for each object.

    Forms: A schema.package.procedure, B schema.procedure (or package.procedure, by the package's prefix), C package.main,
    E schema.$variable, D a procedure by itself. Blocks that execute texts or refresh views are left out, quoted text is
    cut out; C and D give way to an earlier form of the same object in the block or before it.
    """
    blocks = matches(scripts, r"(?s)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)\n\s*\1", "marker", "block").where(~F.col("block").rlike(r"(?i)EXECUTE\s+IMMEDIATE|dbms_mview\.refresh"))
    bare = blocks.select(F.struct("script", "at").alias("script"), F.regexp_replace("block", r"'[^']*'", "''").alias("body"))

    def form(rank: int, letter: str, pattern: str, *groups: str) -> DataFrame:
        found = matches(bare, pattern, *groups)
        none = [F.lit("").alias(g) for g in ("schema", "object", "sub") if g not in groups]
        return found.select(F.col("script.script").alias("script"), F.struct("script.at", F.lit(rank), "at").alias("place"), F.lit(letter).alias("form"), *groups, *none).select("script", "place", "form", F.upper("schema").alias("schema"), F.upper("object").alias("object"), F.upper("sub").alias("sub"))

    number = r"^\d+$"
    a = form(1, "A", r"(?<!['\"])\b(\w+)\.(\w+)\.(\w+)", "schema", "object", "sub")
    a = a.where(~F.col("object").isin("LOG_TIME", *NO_SCHEMAS) & ~F.col("schema").isin(*NO_SCHEMAS) & ~F.col("sub").isin("GET_TIME", "PUT_LINE") & ~F.col("schema").rlike(number) & ~F.col("object").rlike(number))
    b = form(2, "B", r"(?<!['\"\w.])(\w+)\.(\w+)\s*(?:\([^)]*\))?\s*;(?!\s*\.)", "schema", "object")
    b = b.where(~F.col("schema").isin(*NO_SCHEMAS) & ~F.col("object").isin(*NO_NAMES) & ~((F.col("schema") == "SQL") & (F.col("object") == "SQLCODE")) & ~F.col("schema").rlike(number) & ~F.col("object").rlike(number) & ~((F.col("object") == "MAIN") & F.col("schema").startswith("PKG_")))
    package = F.col("schema").startswith("PKG_")
    b = b.select("script", "place", "form", F.when(package, "ATOMIC").otherwise(F.col("schema")).alias("schema"), F.when(package, F.col("schema")).otherwise(F.col("object")).alias("object"), F.when(package, F.col("object")).otherwise("").alias("sub"))
    c = form(3, "C", r"(?i)(?<!['\"\w.])([A-Z_][A-Z0-9_]*)\.(main)\b", "object", "sub").where(~F.col("object").isin("ATOMIC", "SQL", *NO_SCHEMAS)).withColumn("schema", F.lit("ATOMIC"))
    e = form(4, "E", r"(?<!['\".\w])(\w+)\.\$(\w+)\s*\([^)]*\)\s*;", "schema", "object").where(~F.col("schema").isin(*NO_SCHEMAS)).withColumn("object", F.concat(F.lit("$"), "object"))
    d = form(5, "D", r"(?i)(?<!['\"\w.])((?:PROC_|PRC_)[A-Z0-9_]+)(?:\s*\([^)]*\))?\s*;", "object").withColumn("schema", F.lit("ATOMIC"))
    found = a.unionByName(b).unionByName(c).unionByName(e).unionByName(d)
    # What a later form gives way to: the objects, schemas and procedures of forms that stand before it.
    names = found.select("script", "place", F.explode(F.array("object", "schema", F.when(F.col("sub") != "", F.col("sub")))).alias("name"), F.col("form").isin("C", "D").alias("weak"))
    first = names.where("name is not null").groupBy("script", F.col("name").alias("object")).agg(F.min("place").alias("before"))
    found = found.join(first, ["script", "object"], "left").where(~F.col("form").isin("C", "D") | (F.col("before") >= F.col("place")))
    kept = found.groupBy("script", "schema", "object", "sub").agg(F.min_by("form", "place").alias("form"))
    kind = F.when((F.col("sub") != "") | (F.col("form") == "C"), "PACKAGE").otherwise("PROCEDURE")
    return kept.select("script", "form", kind.alias("object_type"), "schema", "object", F.col("sub").alias("sub_object"))
