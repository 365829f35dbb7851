"""Queries by name, each with an optional oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.carriers import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of (spark, sf_dir). ``views``: rollout-shaped views that the oracle reads."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero: how both sides of a check show doubles."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
