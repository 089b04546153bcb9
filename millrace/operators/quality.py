"""Data tests: how many rows or values break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ["test", "column", "bad_rows", "passed"]


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(_column(column).isNull()).alias("bad_rows"))


def duplicated_values(df: DataFrame, column: str) -> DataFrame:
    """Number of values (NULL is one too) that occur more than once."""
    counted = df.groupBy(_column(column)).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count_if(F.col("n") > 1).alias("bad_rows"))


def unexpected_rows(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value is not in the list; NULL passes."""
    return df.agg(F.count_if(~_column(column).isin(list(values))).alias("bad_rows"))


def offending_rows(df: DataFrame) -> DataFrame:
    """A free test: the query gives the bad rows, this counts them."""
    return df.agg(F.count(F.lit(1)).alias("bad_rows"))


def test_report(
    df: DataFrame, tests: Sequence[Mapping[str, Any]], queries: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per test: ``test, column, bad_rows, passed``.

    All row-level tests share one scan; each uniqueness test needs its own
    grouping.  ``queries`` holds the frames of the free tests by name.
    """
    counters: list[Column] = []
    parts: list[DataFrame] = []
    for test in tests:
        kind, column = test["type"], test.get("column")
        if kind == "not_null":
            counters.append(_counted(kind, column, _column(column).isNull()))
        elif kind == "accepted_values":
            if test.get("values"):
                counters.append(_counted(kind, column, ~_column(column).isin(list(test["values"]))))
        elif kind == "unique":
            parts.append(_labelled(duplicated_values(df, column), kind, column))
        elif kind in ("sql", "assert"):
            name = test.get("name", "sql")
            frame = (queries or {}).get(name)
            if frame is None:
                frame = df.sparkSession.sql(test["sql"])
            parts.append(_labelled(offending_rows(frame), name, None))
        else:
            raise ValueError(f"unknown test: {kind}")
    if counters:
        parts.insert(0, df.agg(F.array(*counters).alias("r")).select(F.inline("r")))
    if not parts:
        raise ValueError("no tests given")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.withColumn("passed", F.col("bad_rows") == 0)


def _counted(kind: str, column: str, bad: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("test"), F.lit(column).alias("column"), F.count_if(bad).alias("bad_rows")
    )


def _labelled(df: DataFrame, test: str, column: str | None) -> DataFrame:
    return df.select(
        F.lit(test).alias("test"), F.lit(column).cast("string").alias("column"), "bad_rows"
    )


test_report.__test__ = False  # not a pytest case
