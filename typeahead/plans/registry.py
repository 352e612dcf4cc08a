"""Query registry: one Spark plan per operator key, plus its DuckDB twin.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole test-data tables; the oracle SQL (when given) computes the
same rows in DuckDB from the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from ..session import release

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark, sf_dir):
            # Drop what earlier queries kept in memory, and nothing of others;
            # a query built before this call only recomputes.
            release()
            return fn(spark, sf_dir)
        run.__name__ = getattr(fn, "__name__", key)
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_features, q_lexical, q_prefix, q_dense,  # noqa: F401
                   q_profile, q_text, q_eval, q_io)
