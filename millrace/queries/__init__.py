"""The registered queries: each a Spark function and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Registers a query under its function name."""

    def register(function: QueryFunction) -> QueryFunction:
        from millrace.session import apply_settings

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(apply_settings(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def load() -> None:
    """Import every module that registers queries."""
    from millrace.queries import (  # noqa: F401
        billing,
        maintenance,
        merging,
        operations,
        quality,
        retail,
        usage,
    )
