"""Logs of work to usage events: what was used, and what a unit cost then.

A usage event carries ``tenant_id, workspace_id, meter, quantity, occurred_at,
resource_type, resource_id, provider, region, spot, attributes``.
``with_unit_cost`` adds ``unit_cost_usd``; it is stored with the event, so a
closed month prices the same for ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import dims
from millrace.functions.temporal import hours_in_month
from millrace.usage import money

EVENT_COLUMNS = [
    "id",
    "tenant_id",
    "workspace_id",
    "meter",
    "quantity",
    "occurred_at",
    "resource_type",
    "resource_id",
    "provider",
    "region",
    "spot",
    "attributes",
]


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def usage_rows(
    df: DataFrame,
    meter: str,
    quantity: Column,
    resource_type: Column | None = None,
    resource_id: Column | None = None,
    **attributes: Column,
) -> DataFrame:
    """Events of one meter; rows without a positive quantity are no event."""
    nothing = F.lit(None).cast("string")
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    out = df.select(
        _optional(df, "id", nothing).cast("string").alias("id"),
        F.col("tenant_id"),
        _optional(df, "workspace_id", nothing).alias("workspace_id"),
        F.lit(meter).alias("meter"),
        money.quantity(quantity).alias("quantity"),
        F.col("occurred_at"),
        (nothing if resource_type is None else resource_type).alias("resource_type"),
        (nothing if resource_id is None else resource_id.cast("string")).alias("resource_id"),
        _optional(df, "provider", F.lit("local")).alias("provider"),
        _optional(df, "region", nothing).alias("region"),
        _optional(df, "spot", F.lit(False)).alias("spot"),
        details.alias("attributes"),
    )
    return out.filter(F.col("quantity") > 0)


def meter_queries(query_log: DataFrame, sizes: DataFrame) -> DataFrame:
    """Compute of each query: at least one second, none for a cached result.

    A query on a warehouse of unknown size fails the job: it can't go unbilled.

    Needs ``query_id, warehouse_id, size, min_clusters, wall_seconds,
    warehouse_seconds, bytes_scanned, cache_hit`` beside the event columns.
    """
    shape = F.broadcast(sizes.select(F.col("size").alias("_size"), "ccu_per_minute"))
    ran = query_log.filter(~F.coalesce(F.col("cache_hit"), F.lit(False))).join(
        shape, F.lower("size") == F.col("_size"), "left"
    )
    busy = F.when(F.col("warehouse_seconds") > 0, F.col("warehouse_seconds")).otherwise(
        F.col("wall_seconds")
    )
    seconds = F.greatest(busy, F.lit(dims.MINIMUM_SECONDS)).cast("decimal(18,6)")
    unknown = F.raise_error(F.concat(F.lit("unknown warehouse size: "), F.coalesce("size", F.lit("NULL"))))
    rate = F.when(F.col("ccu_per_minute").isNull(), unknown).otherwise(F.col("ccu_per_minute"))
    burn = rate * F.greatest(F.col("min_clusters"), F.lit(1))
    return usage_rows(
        ran,
        dims.COMPUTE,
        money.part(seconds * burn, 60),
        F.lit("warehouse"),
        F.col("warehouse_id"),
        query_id=F.col("query_id"),
        bytes_scanned=F.col("bytes_scanned"),
        warehouse_size=F.col("size"),
    )


def meter_storage(samples: DataFrame) -> DataFrame:
    """Sampled bytes over a window of ``window_hours``, in GB-months of the sample's month."""
    gb_hours = F.col("bytes_stored").cast("decimal(20,0)") * F.col("window_hours").cast("decimal(8,2)")
    month = hours_in_month(F.col("occurred_at")) * F.lit(float(money.GB))
    named = F.col("table_name").isNotNull()
    return usage_rows(
        samples,
        dims.STORAGE,
        money.part(gb_hours, month),
        F.when(named, F.lit("table")).otherwise(F.lit("lakehouse")),
        F.col("table_name"),
        bytes_stored=F.col("bytes_stored"),
        window_hours=F.col("window_hours"),
    )


def meter_syncs(sync_log: DataFrame) -> DataFrame:
    """Bytes moved by each sync, in GB."""
    return usage_rows(
        sync_log,
        dims.INGEST,
        money.part(F.col("bytes_moved"), money.GB),
        F.lit("pipeline"),
        F.col("source"),
        rows=F.col("records"),
    )


def meter_tasks(task_log: DataFrame) -> DataFrame:
    """Task run time outside warehouses, in minutes."""
    return usage_rows(
        task_log,
        dims.TASKS,
        money.part(F.col("seconds").cast("decimal(18,6)"), 60),
        F.lit("run"),
        F.col("run_id"),
        task=F.col("task"),
    )


def meter_egress(exports: DataFrame) -> DataFrame:
    return usage_rows(exports, dims.EGRESS, money.part(F.col("bytes_out"), money.GB))


def meter_calls(calls: DataFrame) -> DataFrame:
    return usage_rows(calls, dims.API, F.lit(1))


def meter_idle(sessions: DataFrame, sizes: DataFrame, billed_seconds: int = 60) -> DataFrame:
    """Uptime of a stretch of activity, up to ``billed_seconds`` of it, as compute.

    Takes ``operators.running.idle_sessions`` with ``size`` and the event
    columns added; the event is dated at the end of the stretch.
    """
    shape = F.broadcast(sizes.select(F.col("size").alias("_size"), "ccu_per_minute"))
    micros = F.unix_micros(F.col("last_activity_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    uptime = F.least(micros / F.lit(1e6), F.lit(float(billed_seconds))).cast("decimal(18,6)")
    joined = sessions.join(shape, F.lower("size") == F.col("_size"), "left").withColumn(
        "occurred_at", F.col("last_activity_at")
    )
    return usage_rows(
        joined,
        dims.COMPUTE,
        money.part(uptime * F.col("ccu_per_minute"), 60),
        F.lit("warehouse"),
        F.col("warehouse_id"),
        kind=F.lit("uptime"),
        warehouse_size=F.col("size"),
    )


def node_cost_sql(vcpus: str | int, gb_ram: str | int, spot: str = "false") -> str:
    """Hourly price of a machine, from the rate columns of the row."""
    discount = f"IF({spot}, 1.0D - spot_discount, 1.0D)"
    return f"(({vcpus} * vcpu_hour + {gb_ram} * gb_ram_hour) * {discount})"


def priced_rates(df: DataFrame, rates: DataFrame, indexes: DataFrame) -> DataFrame:
    """``df`` with the rate columns of its provider and region.

    Both dimensions are a handful of constant rows, so both are broadcast.
    """
    index = indexes.selectExpr("provider AS _ip", "region AS _ir", "price_index")
    rate = rates.withColumnRenamed("provider", "_rp")
    joined = df.join(F.broadcast(rate), F.expr("provider = _rp"), "left").join(
        F.broadcast(index), F.expr("provider = _ip AND region = _ir"), "left"
    )
    by_region = ("vcpu_hour", "gb_ram_hour", "storage_gb_month")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            F.expr(f"{c} * coalesce(price_index, 1.0D) AS {c}" if c in by_region else c)
            for c in RATE_COLUMNS
        ],
    )


RATE_COLUMNS = [
    "vcpu_hour",
    "gb_ram_hour",
    "spot_discount",
    "storage_gb_month",
    "put_per_1k",
    "get_per_1k",
    "egress_gb",
    "interzone_gb",
]


def unit_cost_sql(spot: str) -> str:
    """Infrastructure cost of one unit of the row's meter, from its rate columns."""
    unit = node_cost_sql(dims.UNIT_VCPUS, dims.UNIT_GB, spot)
    worker = node_cost_sql(dims.TASK_VCPUS, dims.TASK_GB, spot)
    return f"""CAST(CASE meter
        WHEN '{dims.COMPUTE}' THEN {unit} / 60.0D
        WHEN '{dims.STORAGE}' THEN storage_gb_month
        WHEN '{dims.INGEST}' THEN {dims.PUTS_PER_GB / 1000.0}D * put_per_1k
        WHEN '{dims.TASKS}' THEN {worker} / 60.0D
        WHEN '{dims.EGRESS}' THEN egress_gb
        ELSE 0.0D END AS {money.RATE})"""


def with_unit_cost(
    events: DataFrame, rates: DataFrame, indexes: DataFrame, strict: bool = False
) -> DataFrame:
    """Events with the unit cost of their provider, region and meter.

    A provider without rates has a NULL cost, which sums pass over; where the rows
    are going to be billed, ``strict`` fails the job instead.
    """
    unknown = "raise_error('unknown provider: ' || coalesce(provider, 'NULL'))" if strict else "NULL"
    spot = "coalesce(spot, false)" if "spot" in events.columns else "false"
    return priced_rates(events, rates, indexes).selectExpr(
        *[f"`{c}`" for c in events.columns],
        f"IF(vcpu_hour IS NULL, {unknown}, {unit_cost_sql(spot)}) AS unit_cost_usd",
    )


def storage_samples(table_stats: DataFrame, tenant: str, sampled_at: Column, hours: float = 1.0) -> DataFrame:
    """One sample over all tables of a lakehouse; an empty one gives no row."""
    total = table_stats.agg(F.sum("size_bytes").alias("bytes_stored")).filter(
        F.col("bytes_stored") > 0
    )
    return total.select(
        F.lit(tenant).alias("tenant_id"),
        "bytes_stored",
        F.lit(hours).alias("window_hours"),
        F.lit(None).cast("string").alias("table_name"),
        sampled_at.alias("occurred_at"),
    )
