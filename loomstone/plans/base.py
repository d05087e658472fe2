"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) -> DataFrame function, and the DuckDB SQL that gives the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def words_sql(column: str) -> str:
    """SQL for the folded words of a text."""
    return f"list_filter(regexp_split_to_array(lower(strip_accents({column})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"
