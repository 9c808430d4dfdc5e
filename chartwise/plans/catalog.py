"""Registry of named queries and their DuckDB oracle text.

Each plan module registers ``(spark, sf_dir) -> DataFrame`` callables with
``@query(name, oracle=...)``. ``__spark_entry__`` exposes the registry.
Oracle text may name ``fx_*`` fixture views; they are inlined as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartwise.session import configure
from chartwise.sources.fixture_sql import with_fixtures
from chartwise.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, oracle: str | None = None, ids: str = ""):
    """Register a plan under ``name`` with optional oracle SQL and inventory ids."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle)
        IDS[name] = ids
        return fn

    return wrap


def load_all() -> None:
    """Import every plan module so the registry is complete."""
    from chartwise.plans import (  # noqa: F401
        cohort_plans,
        timeline_plans,
        observation_plans,
        split_plans,
        prediction_plans,
        text_plans,
        classify_plans,
    )
