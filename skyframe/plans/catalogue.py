"""Registry of the runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.sources.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None, ctes: str = ""):
    """Register ``fn(views) -> DataFrame`` under ``name`` with optional comparison SQL."""

    def deco(fn):
        def run(spark, root):
            return fn(Views(spark, root))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql, ctes) if views else sql
        return fn

    return deco


def r6(c: str | Column) -> Column:
    """Six decimals, no negative zero: makes float sums comparable across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def s6(expr: str, name: str | None = None) -> str:
    """The SQL twin of :func:`r6`."""
    return f"round({expr},6)+0e0 as {name or expr}"
