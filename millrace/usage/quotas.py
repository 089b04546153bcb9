"""Limits, usage against them, and budgets, for all tenants at one moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import dims
from millrace.functions.temporal import day_end, day_start, hours_in_month, month_end, month_start
from millrace.usage import money
from millrace.usage.summary import usage_between

LIMIT = "decimal(20,6)"

# Quota name, meter, period, unit.
QUOTAS = [
    ("daily_ccu_minutes", dims.COMPUTE, "day", "CCU-min"),
    ("monthly_ccu_minutes", dims.COMPUTE, "month", "CCU-min"),
    ("storage_gb", dims.STORAGE, "month", "GB"),
    ("monthly_ingest_gb", dims.INGEST, "month", "GB"),
    ("daily_task_minutes", dims.TASKS, "day", "task-min"),
]


def free_ccu_minutes() -> Column:
    """Free compute a month in compute units; NULL is unlimited.

    CPU or memory of the free machine, whichever runs out first.
    """
    per_node = F.least(
        F.col("free_vcpus") / F.lit(float(dims.UNIT_VCPUS)),
        F.col("free_gb_ram") / F.lit(float(dims.UNIT_GB)),
    )
    minutes = F.col("compute_hours") * 60.0 * F.greatest(per_node, F.lit(0.0))
    return F.when(F.col("compute_hours") <= 0, F.lit(0.0)).otherwise(minutes)


def effective_limits(plans: DataFrame, free_tiers: DataFrame) -> DataFrame:
    """Limits of every plan on every provider; NULL is unlimited.

    A plan bound to the provider's free tier gets that tier's allowances: the
    month spread evenly over 30 days, and no more ingest than free storage.
    """
    both = plans.crossJoin(F.broadcast(free_tiers)).withColumn("_free", free_ccu_minutes())
    bound, unmetered = F.col("free_tier_bound"), F.col("_free").isNull()
    stored = F.when(F.col("free_storage_gb") > 0, F.col("free_storage_gb"))
    none = F.lit(None).cast("double")
    by_tier = {
        "daily_ccu_minutes": F.when(unmetered, none).otherwise(F.col("_free") / 30.0),
        "monthly_ccu_minutes": F.col("_free"),
        "storage_gb": F.when(unmetered, none).otherwise(F.coalesce(stored, F.col("storage_gb"))),
        # ``least`` skips NULLs, which here stand for no bound.
        "monthly_ingest_gb": F.when(unmetered, none).otherwise(
            F.least(F.col("monthly_ingest_gb"), stored)
        ),
    }
    columns = {
        name: F.when(bound, by_tier[name]).otherwise(F.col(name)).cast(LIMIT) for name in by_tier
    }
    return both.select(
        "plan",
        "provider",
        *[c.alias(n) for n, c in columns.items()],
        F.col("daily_task_minutes").cast(LIMIT).alias("daily_task_minutes"),
        "max_warehouses",
        "max_warehouse_size",
    )


def tenant_limits(accounts: DataFrame, limits: DataFrame) -> DataFrame:
    """``accounts`` (``tenant_id, plan, provider``) with their limits."""
    return accounts.join(F.broadcast(limits), ["plan", "provider"], "left")


def quota_usage(events: DataFrame, as_of: Column) -> DataFrame:
    """Used quantity per tenant for every quota, in one pass over the month so far.

    Storage is metered in GB-months; divided by the elapsed part of the month it
    is GB again.
    """
    at, kind = F.col("occurred_at"), events.schema["occurred_at"].dataType
    month = usage_between(events, month_start(as_of), month_end(as_of)).filter(at <= as_of.cast(kind))
    today = (at >= day_start(as_of).cast(kind)) & (at < day_end(as_of).cast(kind))
    sums = []
    for name, meter, period, _ in QUOTAS:
        counted = F.col("meter") == meter
        if period == "day":
            counted = counted & today
        total = F.coalesce(F.sum(F.when(counted, F.col("quantity"))), F.lit(0))
        sums.append(total.cast("decimal(28,9)").alias(name))
    used = month.groupBy("tenant_id").agg(*sums)
    seconds = (F.unix_micros(as_of) - F.unix_micros(month_start(as_of))) / F.lit(1e6)
    fraction = F.greatest(
        seconds / (hours_in_month(as_of).cast("double") * F.lit(3600.0)), F.lit(1e-6)
    )
    gb = (F.col("storage_gb").cast("double") / fraction).cast("decimal(28,9)")
    return used.withColumn("storage_gb", gb)


def quota_report(
    events: DataFrame,
    accounts: DataFrame,
    limits: DataFrame,
    as_of: Column,
    asks: DataFrame | None = None,
) -> DataFrame:
    """One row per tenant and quota: limit, used, asked for, allowed, remaining, utilization.

    ``asks`` has ``tenant_id`` and any of the quota names as columns, the extra
    amounts wanted.  Reaching a limit exactly is allowed.
    """
    used = quota_usage(events, as_of).withColumnsRenamed({n: f"_u_{n}" for n, *_ in QUOTAS})
    frame = tenant_limits(accounts, limits).join(used, "tenant_id", "left")
    if asks is not None:
        names = [n for n, *_ in QUOTAS if n in asks.columns]
        frame = frame.join(
            asks.select("tenant_id", *[F.col(n).alias(f"_a_{n}") for n in names]), "tenant_id", "left"
        )
    entries = []
    for name, _, _, unit in QUOTAS:
        ask = F.col(f"_a_{name}") if f"_a_{name}" in frame.columns else F.lit(0)
        entries.append(
            F.struct(
                F.lit(name).alias("limit_name"),
                F.col(name).alias("limit_value"),
                F.coalesce(F.col(f"_u_{name}"), F.lit(0)).cast(LIMIT).alias("used"),
                F.coalesce(ask, F.lit(0)).cast(LIMIT).alias("asked"),
                F.lit(unit).alias("unit"),
            )
        )
    rows = frame.select("tenant_id", "plan", "provider", F.inline(F.array(*entries)))
    fits = F.col("used") + F.col("asked") <= F.col("limit_value")
    left = F.greatest(F.col("limit_value") - F.col("used"), F.lit(0)).cast(LIMIT)
    share = F.least(money.part(F.col("used"), F.col("limit_value")), F.lit(1.0))
    return rows.withColumns(
        {
            "allowed": F.col("limit_value").isNull() | fits,
            # NULL, like the limit, where there is none.
            "remaining": F.when(F.col("limit_value").isNotNull(), left),
            "utilization": F.coalesce(share, F.lit(0.0)).cast("decimal(9,4)"),
        }
    )


def warehouse_checks(warehouses: DataFrame, accounts: DataFrame, limits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``warehouses`` (``tenant_id, warehouse_id, size``) against size and count limits.

    One row per tenant and limit it has: the largest machine and the number of
    warehouses in use, and whether that, or one more warehouse, is allowed.
    """
    shape = F.broadcast(sizes.select(F.col("size").alias("_size"), F.col("vcpus").alias("_vcpus")))
    per_tenant = (
        warehouses.join(shape, F.lower("size") == F.col("_size"), "left")
        .groupBy("tenant_id")
        .agg(F.max("_vcpus").alias("largest_vcpus"), F.countDistinct("warehouse_id").alias("warehouses"))
    )
    top = F.broadcast(
        sizes.select(F.col("size").alias("_max_size"), F.col("vcpus").alias("max_vcpus"))
    )
    limited = tenant_limits(accounts, limits).join(
        top, F.col("max_warehouse_size") == F.col("_max_size"), "left"
    )
    frame = limited.join(per_tenant, "tenant_id", "left")
    largest = F.coalesce(F.col("largest_vcpus"), F.lit(0)).cast("bigint")
    count = F.coalesce(F.col("warehouses"), F.lit(0)).cast("bigint")
    entry = [
        F.struct(
            F.lit("max_warehouse_size").alias("limit_name"),
            F.col("max_vcpus").cast("bigint").alias("limit_value"),
            largest.alias("used"),
            (F.col("max_vcpus").isNull() | (largest <= F.col("max_vcpus"))).alias("allowed"),
        ),
        F.struct(
            F.lit("max_warehouses").alias("limit_name"),
            F.col("max_warehouses").cast("bigint").alias("limit_value"),
            count.alias("used"),
            (F.col("max_warehouses").isNull() | (count < F.col("max_warehouses"))).alias("allowed"),
        ),
    ]
    return frame.select("tenant_id", "plan", F.inline(F.array(*entry)))


def budget_breaches(bills: DataFrame, caps: DataFrame) -> DataFrame:
    """Bills that, with what is asked for on top, would pass the tenant's cap.

    ``caps``: ``tenant_id, cap_usd`` and optionally ``asked_usd``.
    """
    asked = F.col("asked_usd") if "asked_usd" in caps.columns else F.lit(0)
    projected = money.amount(F.col("total_usd") + F.coalesce(asked, F.lit(0)))
    return (
        bills.join(caps, "tenant_id")
        .withColumn("projected_usd", projected)
        .filter(F.col("projected_usd") > F.col("cap_usd"))
        .select(
            "tenant_id",
            "period_start",
            "plan",
            "cap_usd",
            money.shown(F.col("projected_usd")).alias("projected_usd"),
        )
    )


def refused(report: DataFrame) -> DataFrame:
    """Per tenant the first quota, in the fixed order, that says no."""
    order = F.array_position(F.array(*[F.lit(n) for n, *_ in QUOTAS]), F.col("limit_name"))
    return (
        report.filter(~F.col("allowed"))
        .groupBy("tenant_id", "plan", "provider")
        .agg(F.min_by("limit_name", order).alias("limit_name"))
    )
