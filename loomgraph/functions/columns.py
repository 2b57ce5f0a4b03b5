"""Column helpers of the fusion and detection operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Job categories by the first prefix that fits (fixed values).
CATEGORY_PREFIXES = (("RPT", "RPT"), ("MV", "MV"), ("FCT", "FCT"), ("DIM", "DIM"), ("STG", "STG"), ("REF", "REF"))
RISKS = ("LOW", "MEDIUM", "HIGH")


def nullif_any(value: Column, tokens: Iterable[str]) -> Column:
    """Null where the trimmed, upper-cased value is one of ``tokens``; each loader has its own set."""
    return F.when(~F.upper(F.trim(value)).isin(*[t.upper() for t in tokens]), value)


def joined(values: Column, by: str = ",") -> Column:
    """Distinct values, sorted and joined; nulls are left out."""
    return F.array_join(F.array_sort(F.array_distinct(values)), by)


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def first_by(value: Column, position: Column) -> Column:
    return F.min_by(value, position)


def ladder(cases: Iterable[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first case that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(list(cases)):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "HIGH", 2).when(risk == "MEDIUM", 1).otherwise(0)


def category_of(job_name: Column) -> Column:
    return ladder([(F.upper(job_name).startswith(p), c) for p, c in CATEGORY_PREFIXES], "OTHER")


def strip_schema(name: Column) -> Column:
    """OWNER.TABLE to TABLE; a database link behind @ goes too."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(name), r"@.*$", ""), r"^.*\.", ""))


def strip_alias(name: Column) -> Column:
    return F.regexp_extract(F.trim(name), r"^(\S*)", 1)


def script_name(command: Column) -> Column:
    """The script of a command line: the last part of the path of its first word ending in .sh, .sql or .exe."""
    return F.regexp_extract(command, r"(?i)([^\s/\\]+\.(?:sh|sql|exe))(?:\s|$)", 1)
