"""Shares, tops, previews and the suggested summary of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import NUMERIC_ORDER, kind_of


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """Some ``n`` rows; nothing is written."""
    return df.limit(n)


def share_of_total(
    df: DataFrame, by: Sequence[str], amount: str, total: str, share: str, digits: int = 1
) -> DataFrame:
    """Sum per group and its percentage of the grand total.

    The grand total is a one-row aggregate of the group sums, joined back as a
    broadcast of that single row: the groups never meet in one task.
    """
    groups = df.groupBy(*by).agg(F.sum(amount).alias(total))
    grand = groups.agg(F.sum(total).alias("_grand"))
    ratio = F.lit(100.0) * F.col(total).cast("double") / F.col("_grand").cast("double")
    return groups.crossJoin(F.broadcast(grand)).select(
        *by, total, ratio.cast(T.DecimalType(9, digits)).alias(share)
    )


def top_per_group(
    df: DataFrame, by: Sequence[str], amount: str, n: int, tie: Sequence[str]
) -> DataFrame:
    """The ``n`` highest rows per group with their rank.

    Spark cuts each task's rows to ``n`` per group before it shuffles them.
    """
    order = Window.partitionBy(*by).orderBy(F.col(amount).desc(), *[F.col(t) for t in tie])
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def last_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    newest = df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)
    return newest.orderBy(*order_by)


def suggest_summary(df: DataFrame) -> tuple[DataFrame, str, str | None]:
    """A first summary of an unknown table: ``(frame, group column, measure)``.

    Groups by the first column that is no number; sums the first number whose
    name does not end in ``id``; counts only when there is none.
    """
    numeric = [f.name for f in df.schema.fields if kind_of(f) in NUMERIC_ORDER]
    group = next((c for c in df.columns if c not in numeric), df.columns[0])
    measure = next((c for c in numeric if not c.lower().endswith("id")), None)
    records = F.count(F.lit(1)).alias("records")
    if measure is None:
        return df.groupBy(group).agg(records).orderBy(F.desc("records")), group, None
    # Summed as decimals, so that the total does not depend on the task order.
    exact = F.col(f"`{measure}`").cast(T.DecimalType(28, 6))
    total = F.sum(exact).cast(T.DecimalType(28, 2)).alias(f"total_{measure}")
    summary = df.groupBy(group).agg(records, total)
    return summary.orderBy(F.desc(f"total_{measure}")), group, measure
