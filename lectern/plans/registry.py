"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL.

Every registered query reads the whole driver tables (or tables Spark derives
from them).  An oracle is omitted only for operators with no SQL form
(iterative/stateful), which are checked against brute force in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


class Tables:
    """Lazy accessor for the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)
