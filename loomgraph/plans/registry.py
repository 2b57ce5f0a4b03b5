"""All queries of the library by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.fixtures import Fixtures, oracle_with

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What was registered: functions of ``Fixtures``, and oracles with their derived relations.
DEFINED: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of ``Fixtures`` under ``name``; ``oracle`` names derived relations as it likes."""

    def put(f: Callable[[Fixtures], DataFrame]) -> Callable:
        DEFINED[name] = f
        _QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle_with(oracle)
        return f

    return put


def _load() -> None:
    from . import detection, fusion, graphs, programme, relational, sources, text  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
