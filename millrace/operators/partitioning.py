"""Partition transforms as derived columns, and layout on write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import SchemaError, find

_CALL = re.compile(r"^(\w+)\s*\(([^)]*)\)$")
_PERIODS = ("year", "month", "day", "hour")


def transform_column(df: DataFrame, expression: str) -> tuple[str, Column]:
    """``(name, column)`` of a partition expression.

    ``days(ts)``, ``bucket(16, id)``, ``truncate(4, name)``, ``identity(c)`` or
    a bare column; the two arguments of bucket and truncate come in any order.
    Bucket numbers are Spark's hash, not another table format's.
    """
    text = expression.strip()
    call = _CALL.match(text)
    if call is None:
        return text, F.col(f"`{_known(df, text).name}`")
    name = call.group(1).lower()
    arguments = [a.strip() for a in call.group(2).split(",") if a.strip()]
    numbers = [int(a) for a in arguments if a.isdigit()]
    columns = [a for a in arguments if not a.isdigit()]
    if len(columns) != 1:
        raise SchemaError(f"one column expected: {expression}")
    source = _known(df, columns[0])
    column = F.col(f"`{source.name}`")
    if name == "identity":
        return source.name, column
    if name.removesuffix("s") in _PERIODS and not numbers:
        period = name.removesuffix("s")
        start = F.date_trunc(period, column.cast("timestamp_ntz"))
        if period == "hour":
            return f"{source.name}_hour", F.date_format(start, "yyyy-MM-dd-HH")
        return f"{source.name}_{period}", start.cast("date")
    if name in ("bucket", "truncate") and len(numbers) == 1 and numbers[0] > 0:
        width = numbers[0]
        if name == "bucket":
            return f"{source.name}_bucket", F.pmod(F.hash(column), F.lit(width))
        if isinstance(source.dataType, T.StringType):
            return f"{source.name}_trunc", F.substring(column, 1, width)
        return f"{source.name}_trunc", column - F.pmod(column, F.lit(width))
    raise SchemaError(f"unsupported partition transform: {expression}")


def _known(df: DataFrame, name: str) -> T.StructField:
    found = find(df.schema, name)
    if found is None:
        raise SchemaError(f"no column {name} to partition by")
    return found


def with_partitions(df: DataFrame, expressions: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame with its partition columns last, and their names."""
    names = []
    for expression in expressions:
        name, column = transform_column(df, expression)
        if name not in df.columns:
            df = df.withColumn(name, column)
        names.append(name)
    return df, names


def laid_out(df: DataFrame, partition_names: list[str], sort_by: list[str]) -> DataFrame:
    """Rows arranged for a write: each partition's rows together, in sort order.

    ``rebalance`` splits a partition value that holds far more rows than the
    others over several files, where a plain hash would give it one task.
    """
    if partition_names:
        df = df.hint("rebalance", *[F.col(f"`{n}`") for n in partition_names])
    order = [*partition_names, *sort_by]
    return df.sortWithinPartitions(*[F.col(f"`{c}`") for c in order]) if sort_by else df
