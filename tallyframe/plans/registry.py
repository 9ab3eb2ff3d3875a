"""Where registered queries and their DuckDB SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: str) -> str:
    """DuckDB SQL: a text without white space at its ends."""
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def normal(c: str) -> str:
    return f"lower({trimmed(f'cast({c} as varchar)')})"


def unpivoted(source: str, columns: list[str]) -> str:
    """DuckDB SQL: (pos, column, value) rows of a source, blank as null."""
    one = [f"select {i} as pos, '{c}' as \"column\", nullif(cast({c} as varchar), '') as value from {source}" for i, c in enumerate(columns)]
    return " union all ".join(one)
