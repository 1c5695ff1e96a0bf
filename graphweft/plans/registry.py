"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweft.plans.adapters import with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_inputs(sql, *inputs)
        return f

    return put


from graphweft.plans import finding, logs, parsing, plane, reading, routing, scalars, trees, wires  # noqa: E402, F401
