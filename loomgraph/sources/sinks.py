"""Sinks by name: where a relation is written, chosen by a word of the configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import workbook_format

Sink = Callable[..., None]
SINKS: dict[str, Sink] = {}


def sink(name: str) -> Callable[[Sink], Sink]:
    def put(write: Sink) -> Sink:
        if name in SINKS:
            raise ValueError(f"sink {name} is registered already")
        SINKS[name] = write
        return write

    return put


def write(df: DataFrame, name: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    if name not in SINKS:
        raise KeyError(f"no sink {name}; there are {', '.join(sorted(SINKS))}")
    SINKS[name](df, path, mode, **options)


@sink("parquet")
def to_parquet(df: DataFrame, path: str, mode: str, **options: str) -> None:
    df.write.mode(mode).options(**options).parquet(path)


@sink("csv")
def to_csv(df: DataFrame, path: str, mode: str, **options: str) -> None:
    df.write.mode(mode).options(**{"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **options}).csv(path)


@sink("json")
def to_json(df: DataFrame, path: str, mode: str, **options: str) -> None:
    df.write.mode(mode).options(**options).json(path)


@sink("workbooks")
def to_workbooks(df: DataFrame, path: str, mode: str, **options: str) -> None:
    """All columns as texts; modes are append and overwrite."""
    workbook_format.register(df.sparkSession)
    df.select(*[df[c].cast("string") for c in df.columns]).write.format("workbooks").mode("append" if mode == "errorifexists" else mode).options(**options).save(path)
