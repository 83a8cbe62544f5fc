"""The registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 4)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to four decimals."""
    return df.select(*[r4(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
