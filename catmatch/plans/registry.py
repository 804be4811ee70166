"""Named queries, each optionally paired with the SQL that states its result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catmatch.plans.oracle_views import with_views
from catmatch.sources.bindings import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, survey: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register `fn(views)` under a name; `survey` lists the inventory rows it covers."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, directory: fn(Views(spark, directory))
        SURVEY_IDS[name] = survey
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn
    return register
