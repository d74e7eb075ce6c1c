"""Registered queries: key → (Spark plan over the airline tables, DuckDB oracle SQL or None).

Every query derives the airline tables from the driver tables of ``sf_dir`` and runs over
them whole. Parameters (``as_of``, search values, request tables) are fixed here and are
themselves derived from the tables, so each query's work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyops.sources import airline
from skyops.sources.oracle_views import with_views

# as_of of the fixtures: flights run 1999-01-01 … 2001-12-31
AS_OF = airline.AS_OF_FIXTURE


def asof():
    """``AS_OF`` as a ``TIMESTAMP_NTZ`` literal (built lazily: Columns need a session)."""
    return airline.ts_ntz(AS_OF)

_ENTRIES: dict[str, tuple[Callable[[airline.Airline], DataFrame], str | None]] = {}
_TABLES: dict[tuple[int, str], airline.Airline] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame`` under ``key`` with its oracle SQL (views are prefixed)."""
    def deco(fn):
        if key in _ENTRIES:
            raise ValueError(f"duplicate query key {key}")
        _ENTRIES[key] = (fn, with_views(sql) if sql else None)
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> airline.Airline:
    """The airline tables of ``sf_dir`` for this session (lazy frames, derived once per session)."""
    k = (id(spark), sf_dir)
    cached = _TABLES.get(k)
    if cached is None or cached.airplane.sparkSession is not spark:
        cached = _TABLES[k] = airline.derive(spark, sf_dir)
    return cached


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: (lambda fn: (lambda spark, sf_dir: fn(tables(spark, sf_dir))))(fn)
            for k, (fn, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: s for k, (_, s) in _ENTRIES.items() if s}


def _load_all() -> None:
    # importing the query modules registers their entries
    from skyops.plans import (q_reports, q_relational, q_functions, q_search,  # noqa: F401
                              q_availability, q_booking, q_planning, q_quality, q_registration,
                              q_sources)
