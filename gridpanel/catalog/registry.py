"""Registered queries and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from gridpanel.catalog.views import with_views
from gridpanel.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``f(spark, sf_dir)``; ``views`` lists the fixture views its SQL reads."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(function)
        def shipped(spark, sf_dir):
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return function

    return register
