"""Names of the engine's queries, each with its Spark form and, where SQL has one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name."""

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def _catalogue():
    from . import catalogue, forms, official, records, streams  # noqa: F401  they register their queries when they are imported

    return catalogue


def queries() -> dict[str, Query]:
    _catalogue()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _catalogue()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue().flagship(spark, sf_dir)
