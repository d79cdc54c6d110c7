"""Registered queries: one per operator of SURVEY §2 that is implemented.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` over the
driver tables (or views Spark derives from them) and, where the result is
SQL-expressible, a DuckDB twin used as the correctness oracle. Output
columns carry the same names on both sides; doubles are rounded to 6
decimals on both sides so summation order cannot change the hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    spark_fn: Callable[[SparkSession, str], DataFrame]
    sql_fn: Callable[[], str] | None = None
    tags: tuple = field(default_factory=tuple)


def register(name: str, sql: Callable[[], str] | None = None, tags: tuple = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tags)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import (q_dialect, q_text, q_formats, q_quality, q_dedup, q_sampling,  # noqa: F401
                   q_metrics, q_encode, q_joins, q_stream, q_extra)
    return REGISTRY
