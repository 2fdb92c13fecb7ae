"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, whole: bool = False):
    """Registers a function as the query of its name, with the SQL of the same result. whole: the SQL names its views itself."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            from .views import with_views

            ORACLES[f.__name__] = sql if whole else with_views(sql)
        return f

    return add


def _load() -> None:
    from . import event_queries, geometry_queries, grid_queries, image_queries, recon_queries, response_queries, simulation_queries, study_queries, variance_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
