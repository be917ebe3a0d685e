"""Named queries: each pairs a DataFrame function with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans.fixtures import Tables, with_views
from shelfmark.session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register a builder under ``name``; ``ops`` lists the operator ids it exercises."""
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(ops.split()), build, with_views(sql) if sql else None)
        return build

    return wrap


def load_all() -> dict[str, Query]:
    from shelfmark.plans import (  # noqa: F401
        classify_queries,
        dedup_queries,
        file_queries,
        model_queries,
        plan_queries,
        quality_queries,
        registry_queries,
        report_queries,
        source_queries,
        stream_queries,
        sync_queries,
        text_queries,
        transition_queries,
    )

    return QUERIES
