"""Registered queries over the given tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a function under its name, with its SQL; ints names columns that Spark gives as 32-bit integers."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if ints else sql
        return f

    return register


from . import bars, screens, texts  # noqa: E402, F401
