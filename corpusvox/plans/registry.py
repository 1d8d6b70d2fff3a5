"""Registry of named queries over the fixture tables, each with its SQL twin.

A query is ``fn(spark, sf_dir) -> DataFrame`` that wires library operators to
the driver tables (see FIXTURES.md for the stand-in mapping).  ``sql`` is the
same result written as plain SQL over the tables as views; it is omitted for
operators whose semantics are sequential folds or need Python (zlib, numpy).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import functools

from corpusvox import tables
from corpusvox.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return tables.load(spark, sf_dir, name, spread)
