"""Warehouse sizes: what they cost and which one a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.usage import money
from millrace.usage.metering import node_cost_sql, priced_rates

#: Scan speed per vCPU and the wanted run time (fixed values).
MB_PER_SECOND = 120.0
TARGET_SECONDS = 30.0


def size_array(sizes: DataFrame) -> DataFrame:
    """One row with the sizes from small to large."""
    return sizes.agg(
        F.array_sort(F.collect_list(F.struct("vcpus", "size", "ccu_per_minute"))).alias("_sizes")
    )


def recommend(scanned: Column, sizes: Column, target: float, speed: float) -> Column:
    """Smallest size with enough vCPUs to scan the bytes in time; the largest if none has."""
    needed = scanned.cast("double") / 1e6 / F.lit(speed * max(target, 1.0))
    enough = F.filter(sizes, lambda s: s["vcpus"] >= needed)
    chosen = F.coalesce(F.get(enough, F.lit(0)), F.element_at(sizes, -1))
    return F.when(scanned <= 0, F.get(sizes, F.lit(0))["size"]).otherwise(chosen["size"])


def recommend_sizes(
    query_log: DataFrame,
    sizes: DataFrame,
    bytes_scanned: str = "bytes_scanned",
    target: float = TARGET_SECONDS,
    speed: float = MB_PER_SECOND,
) -> DataFrame:
    """``query_log`` with the recommended size of each query."""
    listed = query_log.crossJoin(F.broadcast(size_array(sizes)))
    best = recommend(F.col(bytes_scanned), F.col("_sizes"), target, speed)
    return listed.withColumn("recommended_size", best).drop("_sizes")


def size_costs(
    warehouses: DataFrame, sizes: DataFrame, rates: DataFrame, indexes: DataFrame
) -> DataFrame:
    """Hourly cost of each warehouse: ``size, provider, region, spot, min_clusters, unit_price_usd``.

    ``unit_price_usd`` is the charge per compute-unit minute on top of the machine.
    """
    shape = F.broadcast(sizes.withColumnRenamed("size", "_size"))
    sized = priced_rates(warehouses, rates, indexes).join(
        shape, F.lower("size") == F.col("_size"), "left"
    )
    clusters = F.greatest(F.col("min_clusters"), F.lit(1))
    infra = F.expr(node_cost_sql("vcpus", "gb_ram", "spot")) * clusters
    units = F.col("ccu_per_minute") * clusters * F.lit(60)
    charge = units * F.col("unit_price_usd").cast("double")
    return sized.select(
        *warehouses.columns,
        money.shown(infra).alias("infra_usd_per_hour"),
        units.cast("bigint").alias("ccu_per_hour"),
        money.shown(charge).alias("ccu_usd_per_hour"),
        money.shown(infra + charge).alias("total_usd_per_hour"),
    )
