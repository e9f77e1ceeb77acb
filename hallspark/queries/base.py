"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a view reader under its name, with the DuckDB text (names in braces are views) of the same result."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(partial(view, spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql).replace("@<", "{").replace(">@", "}")  # braces that name no view
        return f

    return add


def rnd(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS BIGINT)"


def cents(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5e0) / 100e0"


def clamped(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(100e0, greatest(0e0, {x})) END"


def pct(part: str, whole: str = "count(*)") -> str:
    return rnd(f"{part} * 100e0 / greatest({whole}, 1)")
