"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadastra.plans.bridge import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL of the same rows where there is some."""
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from cadastra.plans import q_geometry, q_graph, q_jobs, q_matching, q_sheet, q_text  # noqa: F401
