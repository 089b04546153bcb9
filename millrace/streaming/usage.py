"""Usage per time window while the events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.usage import money
from millrace.usage.summary import cost


def usage_windows(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Quantity and cost per tenant, meter and window, updated with every batch.

    State is kept for open windows only.  An event that comes later than
    ``lateness`` is left out here; the batch summary of the period counts it.
    """
    timed = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return (
        timed.withWatermark("occurred_at", lateness)
        .groupBy(F.window("occurred_at", width), "tenant_id", "meter")
        .agg(
            money.quantity(F.sum("quantity")).alias("quantity"),
            money.amount(F.sum(cost())).alias("infra_cost_usd"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(
            F.col("window.start").alias("period_start"),
            "tenant_id",
            "meter",
            "quantity",
            "infra_cost_usd",
            "events",
        )
    )


def activity_sessions(activities: DataFrame, by: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Open stretches of activity per resource.

    Unlike ``operators.running.idle_sessions`` a pause of exactly the gap does
    not end a stretch.
    """
    timed = activities.withColumn(at, F.col(at).cast("timestamp"))
    return (
        timed.withWatermark(at, lateness)
        .groupBy(F.session_window(at, gap).alias("s"), by)
        .agg(F.count(F.lit(1)).alias("activities"))
        .select(by, F.col("s.start").alias("started_at"), F.col("s.end").alias("ends_at"), "activities")
    )
