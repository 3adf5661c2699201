"""Query registry: each entry pairs a DataFrame query with the SQL that states its result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonecraft.session import spread, tune

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ["sources_plans", "quality_plans", "relational_plans", "dims_plans", "drift_plans", "privacy_plans", "metadata_plans", "rank_plans", "stream_plans"]


class Tables:
    """Lazy access to the Parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row (text, vectors)."""
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`, with its SQL statement when one exists."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"zonecraft.plans.{m}")


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]
    return lambda spark, folder: fn(Tables(spark, folder))
