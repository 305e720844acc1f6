"""Where catalogue modules register a query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkveil.session import configure
from sparkveil.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Decorator: `sql` may use the named views as if they were tables."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(configure(spark), sf_dir)
        if sql is not None:
            if views and sql.lstrip().upper().startswith("WITH "):
                head = with_views(views, "").rstrip()
                ORACLES[name] = head + ", " + sql.lstrip()[5:]
            else:
                ORACLES[name] = with_views(views, sql) if views else sql
        return build

    return register
