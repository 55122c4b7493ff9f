"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dunlake.catalog.views import VIEWS, view_sql

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and stand-in views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            source, columns = VIEWS[name]
            view = getattr(self, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
            self.__dict__[name] = view
            return view
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Prefix the SQL with the stand-in views it mentions."""
    needed = [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]
    if not needed:
        return sql
    views = ", ".join(f"{name} AS ({view_sql(name)})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    """Register ``function(inputs)`` under a name, with the SQL that must give the same rows."""

    def register(function: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register
