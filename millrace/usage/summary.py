"""Usage rolled up by tenant, meter, period, workspace and resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.summaries import last_rows, top_per_group
from millrace.usage import money


#: The partition column that ``days(occurred_at)`` makes.
DAY_COLUMN = "occurred_at_day"


def usage_between(
    events: DataFrame,
    start: Column,
    end: Column,
    tenant: str | None = None,
    meter: str | None = None,
    workspace: str | None = None,
) -> DataFrame:
    """Events in ``[start, end)``, optionally of one tenant, meter or workspace.

    A table partitioned by ``days(occurred_at)`` is read for those days only, if
    ``events`` has the day column (``Lakehouse.read(table, derived=True)``).
    """
    low, high = _in_type_of(events, start), _in_type_of(events, end)
    kept = events.filter((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))
    if DAY_COLUMN in events.columns:
        kept = kept.filter(F.col(DAY_COLUMN).between(F.to_date(start), F.to_date(end))).drop(DAY_COLUMN)
    for column, wanted in (("tenant_id", tenant), ("meter", meter), ("workspace_id", workspace)):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    return kept


def cost(quantity: str = "quantity", unit_cost: str = "unit_cost_usd") -> Column:
    return F.col(quantity) * F.col(unit_cost)


def _in_type_of(events: DataFrame, bound: Column) -> Column:
    """The bound in the type of the event time, so that the scan can use it."""
    return bound.cast(events.schema["occurred_at"].dataType)


def _totals() -> list[Column]:
    return [
        money.quantity(F.sum("quantity")).alias("quantity"),
        money.amount(F.sum(cost())).alias("infra_cost_usd"),
    ]


def summarize(events: DataFrame, period: str = "month", providers: bool = True) -> DataFrame:
    """``tenant_id, period_start, meter`` with quantity, cost, events and providers.

    One grouping for all tenants; each task adds up its rows first, so a tenant
    with most of the events is no hot spot.  The sums are taken per provider
    first, which keeps the list building away from the events.
    """
    keys = ["tenant_id", "period_start", "meter"]
    dated = events.withColumn("period_start", F.date_trunc(period, "occurred_at"))
    if not providers:
        return dated.groupBy(*keys).agg(*_totals(), F.count(F.lit(1)).alias("events"))
    parts = dated.groupBy(*keys, "provider").agg(
        F.sum("quantity").alias("_q"), F.sum(cost()).alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    return parts.groupBy(*keys).agg(
        money.quantity(F.sum("_q")).alias("quantity"),
        money.amount(F.sum("_c")).alias("infra_cost_usd"),
        F.sum("_n").alias("events"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
    )


def by_resource(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` costliest resources per tenant, highest first."""
    resource = F.concat(
        F.coalesce(F.col("resource_type"), F.lit("resource")), F.lit(":"), F.col("resource_id")
    )
    summed = (
        events.filter(F.col("resource_id") != "")
        .groupBy("tenant_id", resource.alias("resource"))
        .agg(money.amount(F.sum(cost())).alias("infra_cost_usd"))
    )
    return top_per_group(summed, ["tenant_id"], "infra_cost_usd", n, ["resource"])


def chargeback(events: DataFrame) -> DataFrame:
    """Totals by tenant, workspace and meter, with their subtotals.

    ``level`` is 0 for the detail, 1 per workspace, 3 per tenant, 7 overall;
    it tells a subtotal from a missing workspace.
    """
    # Added up at the finest level first: only those sums are multiplied by the rollup.
    detail = events.groupBy("tenant_id", "workspace_id", "meter").agg(
        F.sum("quantity").alias("_q"), F.sum(cost()).alias("_c")
    )
    return detail.rollup("tenant_id", "workspace_id", "meter").agg(
        F.grouping_id().cast("int").alias("level"),
        money.quantity(F.sum("_q")).alias("quantity"),
        money.amount(F.sum("_c")).alias("infra_cost_usd"),
    )


def totals(events: DataFrame, period: str = "day") -> DataFrame:
    """Quantity per tenant, meter and period."""
    return events.groupBy(
        "tenant_id", "meter", F.date_trunc(period, "occurred_at").alias("period_start")
    ).agg(money.quantity(F.sum("quantity")).alias("quantity"))


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events, oldest first."""
    return last_rows(events, ["occurred_at", "id"], n)


def dashboard(table_stats: DataFrame, events: DataFrame) -> DataFrame:
    """One row: how many tables, rows and bytes, and the usage by meter."""
    tables = table_stats.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )
    used = (
        events.groupBy("meter")
        .agg(money.quantity(F.sum("quantity")).alias("quantity"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meter", "quantity")))).alias("usage"))
    )
    return tables.crossJoin(F.broadcast(used))
