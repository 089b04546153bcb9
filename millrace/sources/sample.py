"""Retail sample data, the same for a seed under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import values_table

CUSTOMERS = """
  ('larch', 'Larch Street Bakery', 'DE'),
  ('fennel', 'Fennel and Sons', 'PT'),
  ('quayside', 'Quayside Books', 'NL'),
  ('tallow', 'Tallow Candles', 'DE'),
  ('heron', 'Heron Bicycles', 'DK')
"""
PRODUCTS = """
  (0, 'lamp-01', 'Desk lamp', 'lighting', 34.00),
  (1, 'lamp-02', 'Wall lamp', 'lighting', 51.90),
  (2, 'rope-10', 'Cotton rope 10m', 'workshop', 7.35),
  (3, 'nail-06', 'Nails 6cm x200', 'workshop', 4.80),
  (4, 'vase-03', 'Glass vase', 'household', 18.25)
"""


def customers(spark: SparkSession) -> DataFrame:
    return values_table(spark, CUSTOMERS, "customer_id STRING; name STRING; country STRING")


def orders(
    spark: SparkSession, count: int = 500, seed: int = 42, days: int = 30, until: str = "2026-01-31"
) -> DataFrame:
    """``count`` orders over the ``days`` before ``until``, with ``ordered_at`` as cursor."""
    products = values_table(
        spark,
        PRODUCTS,
        "_p INT; sku STRING; product STRING; category STRING; unit_price DOUBLE",
    )
    names = F.array(*[F.lit(n) for n in ("larch", "fennel", "quayside", "tallow", "heron")])

    def draw(purpose: str, below: int) -> Column:
        """A number from 0 to ``below`` - 1 that depends on order, seed and purpose only."""
        return F.pmod(F.xxhash64("order_id", F.lit(seed), F.lit(purpose)), F.lit(below))

    start = F.to_timestamp(F.lit(until)) - F.make_dt_interval(days=F.lit(days))
    return (
        spark.range(1, count + 1)
        .withColumnRenamed("id", "order_id")
        .withColumn("customer_id", F.get(names, draw("customer", 5).cast("int")))
        .withColumn("_p", draw("product", 5).cast("int"))
        .join(F.broadcast(products), "_p")
        .withColumn("quantity", draw("quantity", 12) + 1)
        .withColumn("amount", F.round(F.col("quantity") * F.col("unit_price"), 2))
        .withColumn(
            "ordered_at", start + F.make_dt_interval(secs=draw("time", days * 86_400 + 1))
        )
        .select(
            "order_id", "customer_id", "sku", "product", "category", "quantity", "unit_price",
            "amount", "ordered_at",
        )
    )
