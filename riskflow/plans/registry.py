"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from riskflow.session import configure

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the independent DuckDB formulation (None = no SQL twin)."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            configure(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
