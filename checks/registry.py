"""Where checks register: a Spark query, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return register


def r6(value: Column | str) -> Column:
    """Six decimals, without negative zero."""
    c = F.round(value, 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def q6(expression: str) -> str:
    """The same in SQL."""
    rounded = f"round(CAST({expression} AS DOUBLE), 6)"
    return f"(CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END)"
