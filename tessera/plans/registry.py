"""Registry of named queries over the driver's tables.

Each query is a function ``(spark, sf_dir) -> DataFrame`` that runs library
operators on the whole tables; ``oracle`` is the equivalent SQL for DuckDB
(absent for iterative / randomised operators, which are tested against a brute
force on small fixtures instead).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Import the query modules for their registration side effect.
    from . import (queries_cleaning, queries_columns, queries_dataset, queries_flows, queries_metrics,  # noqa: F401
                   queries_outliers, queries_prepare,
                   queries_models, queries_quality, queries_relational, queries_spatial,
                   queries_sources, queries_splits)
    return QUERIES
