"""Named queries and, where SQL can state them, their plain-SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans.base import with_views
from tidegrid.sources.retail import Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register fn(Retail) -> DataFrame; ``views`` names the shared views its SQL uses."""

    def wrap(fn: Callable[[Retail], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Retail(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return fn

    return wrap
