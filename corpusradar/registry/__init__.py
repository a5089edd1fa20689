"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusradar.registry.sqlviews import with_views
from corpusradar.session import UNION_PARTITIONING
from corpusradar.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SQL: dict[str, tuple[str, str]] = {}

FAMILIES = [
    "ingest", "vectors", "clusters", "velocity", "scoring", "chunking", "lexical", "fusion", "questions",
    "catalog", "sessions", "opsmetrics", "evaluation", "streams", "stored",
]


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name`` together with its DuckDB text."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set(UNION_PARTITIONING, "false")
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (views, sql)
        return fn

    return register


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"corpusradar.registry.{family}")
    for name, (views, sql) in _SQL.items():
        ORACLES[name] = with_views(views, sql)
