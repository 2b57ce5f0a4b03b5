"""Where the variables of a script come from: a table function that reads a script's lines in order and carries state.

``references`` runs as a Python UDTF over the lines of all scripts. Its ``analyze`` takes any table with a column of lines and one of
their numbers, deals it by the script's column, whatever its type, and returns that column beside the findings. A task holds the
assignments and references of one script.

What is found: refreshes of materialised views, by literal or variable (kind MV_REFRESH, or MV_REFRESH_WITH_TRUNCATE where a table
with that name is truncated), and statements that are executed from a text (EXECUTE_IMMEDIATE), with the shell's positional
parameters that stand behind their variables.

Defined results: assignments and calls are read within a line; a null line is an empty one; the first assignment of a name in the
script counts, also of a longer name that ends with it; a variable without one stands for itself; scripts without references have no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Characters behind a statement's start in which its arguments are looked for (fixed value).
WINDOW = 500

# The forms of calls and assignments in the analysed scripts.
REFRESH = re.compile(r"dbms_mview\.refresh\s*\(\s*(?:'([^']+)'|(\w+))", re.I)
EXECUTE = re.compile(r"\bEXECUTE\s+IMMEDIATE\b", re.I)
FROM_PARAMETER = re.compile(r"(\w+)\s*=\s*\$(\d+)")
FROM_WORD = re.compile(r"(\w+)\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$")
FROM_SHELL = re.compile(r"(\w+)\s+\w+(?:\(\d+\))?\s*:=\s*'(?:\$\{(\w+)\}|\$(\w+))'")
TRUNCATE = re.compile(r"TRUNCATE\s+TABLE(.*)", re.I)
SHELL_VARIABLE = re.compile(r"\$\{?\w+\}?")
USING = re.compile(r"USING\s+(.*?);", re.I | re.S)

FOUND = [StructField("at", IntegerType()), StructField("kind", StringType()), StructField("name", StringType()), StructField("is_parameter", BooleanType()), StructField("position", StringType())]


@dataclass
class State:
    """What the lines of a script have said so far."""

    parameters: dict[str, str] = field(default_factory=dict)
    words: dict[str, str] = field(default_factory=dict)
    shell: dict[str, str] = field(default_factory=dict)
    truncated: list[str] = field(default_factory=list)
    refreshed: list[tuple[int, str | None, str | None]] = field(default_factory=list)
    executed: list[tuple[int, list[str]]] = field(default_factory=list)
    matches: int = 0

    def read(self, line: str) -> None:
        for _, parts in self.executed:
            if (room := WINDOW - sum(map(len, parts))) > 0:
                parts.append(line[:room])
        for m in FROM_PARAMETER.finditer(line):
            self.parameters.setdefault(m[1], m[2])
        for m in FROM_WORD.finditer(line.rstrip("\n")):
            self.words.setdefault(m[1], m[2])
        for m in FROM_SHELL.finditer(line):
            self.shell.setdefault(m[1].lower(), m[2] or m[3])
        self.truncated += [m[1].lower() for m in TRUNCATE.finditer(line)]
        starts = [(m.start(), m) for p in (REFRESH, EXECUTE) for m in p.finditer(line)]
        for _, m in sorted(starts, key=lambda s: s[0]):
            if m.re is REFRESH:
                self.refreshed.append((self.matches, m[1], m[2]))
            else:
                self.executed.append((self.matches, [line[m.end() : m.end() + WINDOW]]))
            self.matches += 1

    def position(self, variable: str) -> str | None:
        return next((n for name, n in self.parameters.items() if name.endswith(variable)), None)

    def resolved(self, variable: str) -> tuple[bool, str, str]:
        """Whether it comes from a parameter, which, and else its value, or itself."""
        if n := self.position(variable):
            return True, f"${n}", ""
        word = next((w for name, w in self.words.items() if name.endswith(variable)), variable)
        return False, "", word.upper()

    def refresh(self, at: int, literal: str | None, variable: str | None) -> tuple:
        given, place, name = False, "", (literal or "").upper()
        if variable:
            given, place, name = self.resolved(variable)
            inner = next((s for n, s in self.shell.items() if n.endswith(variable.lower())), None)
            if not given and name == variable.upper() and inner:
                given, place, name = self.resolved(inner)
            if given:
                name = f"(parameter {place})"
        needle = (literal or variable or "").lower()
        kind = "MV_REFRESH_WITH_TRUNCATE" if any(needle in t for t in self.truncated) else "MV_REFRESH"
        return at, kind, name, given, place

    def execution(self, at: int, parts: list[str]) -> tuple:
        text = "".join(parts)
        using = USING.search(text)
        places = [f"${n}" for v in re.findall(r"\w+", using[1] if using else "") if (n := self.position(v))]
        return at, "EXECUTE_IMMEDIATE", "", bool(SHELL_VARIABLE.search(text)), ",".join(places)


class ScriptReferences:
    """The UDTF; see the module."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, script: AnalyzeArgument, number: AnalyzeArgument, line: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table of lines")
        names = [a.value for a in (script, number, line)]
        if missing := [n for n in names if n not in rows.dataType.names]:
            raise ValueError(f"the table has no column {', '.join(map(str, missing))}")
        own = rows.dataType[names[0]]
        return AnalyzeResult(StructType([StructField("script", own.dataType), *FOUND]), partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self) -> None:
        self.state, self.script = State(), None

    def eval(self, row, script: str, number: str, line: str):
        self.script = row[script]
        self.state.read(f"{row[line] or ''}\n")

    def terminate(self):
        found = [self.state.refresh(*r) for r in self.state.refreshed] + [self.state.execution(*e) for e in self.state.executed]
        for f in sorted(found):
            yield (self.script, *f)


def lines_of(scripts: DataFrame) -> DataFrame:
    """(script, number, line) of (script, body)."""
    return scripts.select("script", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("number", "line"))


def register(spark: SparkSession) -> None:
    """Make ``script_references(TABLE(...), 'script', 'number', 'line')`` known to SQL."""
    spark.udtf.register("script_references", F.udtf(ScriptReferences))


def references(scripts: DataFrame) -> DataFrame:
    """(script, at, kind, name, is_parameter, position) of (script, body); ``at`` counts a script's references from 0."""
    register(scripts.sparkSession)
    return scripts.sparkSession.sql("SELECT * FROM script_references(TABLE({lines}), 'script', 'number', 'line')", lines=lines_of(scripts))
