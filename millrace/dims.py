"""Constant dimensions: sizes, provider rates, free tiers, plans, discount tiers.

Each is a handful of rows, so joins with them are broadcast without a check.
Every builder takes overrides: pass your own rows to price with other rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import values_table

# --------------------------------------------------------------- fixed values
# Warehouse sizes: name, nodes, vCPUs per node, GB of memory per node.
SIZES = """
  ('xs', 1, 2, 8),
  ('s', 1, 4, 16),
  ('m', 2, 4, 16),
  ('l', 4, 4, 16),
  ('xl', 8, 4, 16),
  ('2xl', 16, 4, 16),
  ('3xl', 32, 4, 16),
  ('4xl', 64, 4, 16)
"""

# Provider list prices in USD: vCPU hour, GB memory hour, spot discount, storage
# GB-month, 1,000 PUTs, 1,000 GETs, egress GB, traffic between zones per GB.
RATES = """
  ('aws', 0.0336, 0.0036, 0.70, 0.023, 0.005, 0.0004, 0.09, 0.01),
  ('azure', 0.0336, 0.0036, 0.72, 0.018, 0.0055, 0.0004, 0.087, 0.01),
  ('gcp', 0.0340, 0.0036, 0.80, 0.020, 0.005, 0.0004, 0.12, 0.01),
  ('tencent', 0.0217, 0.0023, 0.75, 0.0138, 0.0015, 0.0002, 0.08, 0.005),
  ('alibaba', 0.0242, 0.0026, 0.80, 0.0148, 0.0015, 0.0002, 0.074, 0.005),
  ('generic', 0.0029, 0.0007, 0.0, 0.006, 0.0, 0.0, 0.001, 0.0),
  ('local', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
"""

# Regions that change a provider's vCPU, memory and storage prices.
REGION_INDEXES = """
  ('aws', 'us-east-1', 1.00),
  ('aws', 'us-west-2', 1.00),
  ('aws', 'eu-central-1', 1.08),
  ('aws', 'ap-southeast-1', 1.14),
  ('aws', 'ap-southeast-7', 1.12),
  ('aws', 'ap-south-1', 0.96)
"""

# Regions and their published price index, for finding the cheapest one.
REGIONS = """
  ('aws', 'us-east-1', 1.00), ('aws', 'us-west-2', 1.00), ('aws', 'eu-central-1', 1.08),
  ('aws', 'ap-southeast-1', 1.14), ('aws', 'ap-southeast-7', 1.12), ('aws', 'ap-south-1', 0.96),
  ('azure', 'eastus', 1.00), ('azure', 'westeurope', 1.09), ('azure', 'southeastasia', 1.12),
  ('azure', 'centralindia', 0.95),
  ('gcp', 'us-central1', 1.00), ('gcp', 'europe-west4', 1.08), ('gcp', 'asia-southeast1', 1.13),
  ('gcp', 'asia-south1', 0.98),
  ('tencent', 'ap-bangkok', 1.00), ('tencent', 'ap-singapore', 1.05),
  ('tencent', 'ap-guangzhou', 0.92), ('tencent', 'ap-hongkong', 1.03),
  ('alibaba', 'ap-southeast-1', 1.00), ('alibaba', 'ap-southeast-7', 1.02),
  ('alibaba', 'cn-hangzhou', 0.88), ('alibaba', 'ap-south-1', 0.97)
"""

# Free tiers: compute hours a month, vCPUs and GB memory of the free machine,
# storage GB.  NULL is unlimited.
FREE_TIERS = """
  ('aws', 750.0, 2.0, 1.0, 5.0),
  ('azure', 750.0, 1.0, 1.0, 5.0),
  ('gcp', 744.0, 2.0, 1.0, 5.0),
  ('tencent', 0.0, 2.0, 1.0, 50.0),
  ('alibaba', 0.0, 2.0, 1.0, 5.0),
  ('generic', 0.0, 2.0, 1.0, 0.0),
  ('local', NULL, 2.0, 1.0, NULL)
"""

# Plans: name, shown name, monthly minimum USD, commitments available, bound to
# the provider's free tier, then limits (NULL is unlimited): warehouses, largest
# warehouse, daily and monthly compute, storage GB, monthly ingest GB, daily
# orchestration minutes, concurrent queries, users, retention days.
PLANS = """
  ('trial', 'Trial', 0.0, false, true,
   1, 'xs', 360.0, NULL, 5.0, 5.0, 60.0, 2, 3, 14),
  ('community', 'Community (self-hosted)', 0.0, false, false,
   NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 90),
  ('team', 'Team', 99.0, true, false,
   NULL, NULL, NULL, NULL, NULL, NULL, NULL, 20, 25, 180),
  ('business', 'Business', 999.0, true, false,
   NULL, NULL, NULL, NULL, NULL, NULL, NULL, 100, NULL, 365),
  ('enterprise', 'Enterprise', 4999.0, true, false,
   NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1095)
"""

# Platform fee bands, marginal: plan, from USD, up to USD (NULL is no end), rate.
FEE_BANDS = """
  ('team', 0.0, 2000.0, 0.30),
  ('team', 2000.0, 10000.0, 0.22),
  ('team', 10000.0, 50000.0, 0.15),
  ('team', 50000.0, NULL, 0.10),
  ('business', 0.0, 10000.0, 0.20),
  ('business', 10000.0, 50000.0, 0.13),
  ('business', 50000.0, NULL, 0.09),
  ('enterprise', 0.0, NULL, 0.08)
"""

# Add-ons: plan, meter, included a month (NULL is unlimited), USD per unit beyond.
ADDONS = """
  ('team', 'ingest_gb', 100.0, 0.02),
  ('business', 'ingest_gb', 1000.0, 0.015),
  ('enterprise', 'ingest_gb', NULL, 0.01)
"""

# Commitment: months, discount.  Credit purchase: from USD, bonus.
COMMITMENT_TIERS = "(0, 0.0), (12, 0.15), (36, 0.25)"
CREDIT_TIERS = "(10000.0, 0.05), (50000.0, 0.10), (100000.0, 0.15)"

# Other platforms' list price per compute unit hour (estimates).
PLATFORM_PRICES = """
  ('snowflake_standard', 0.250),
  ('databricks_sql_serverless', 0.550),
  ('databricks_jobs_compute', 0.220),
  ('bigquery_on_demand', 0.310)
"""

# Meters in bill order: name, unit.
METERS = """
  ('compute_ccu_minute', 'CCU-min'),
  ('storage_gb_month', 'GB-month'),
  ('ingest_gb', 'GB'),
  ('orchestration_task_minute', 'task-min'),
  ('egress_gb', 'GB'),
  ('api_request', 'requests')
"""
METER_NAMES = [
    "compute_ccu_minute",
    "storage_gb_month",
    "ingest_gb",
    "orchestration_task_minute",
    "egress_gb",
    "api_request",
]
COMPUTE, STORAGE, INGEST, TASKS, EGRESS, API = METER_NAMES

#: One compute unit is 1 vCPU and 4 GB; a task worker has 1 vCPU and 2 GB.
UNIT_VCPUS, UNIT_GB = 1, 4
TASK_VCPUS, TASK_GB = 1, 2
#: PUT requests per GB written.
PUTS_PER_GB = 8
#: A query is charged at least this long.
MINIMUM_SECONDS = 1.0
#: Share of a verified saving that is charged.
EFFICIENCY_SHARE = 0.30
#: Markups on storage and egress cost.
STORAGE_MARKUP = 0.0
EGRESS_MARKUP = 0.0
# ---------------------------------------------------------- end of fixed values


def sizes(spark: SparkSession, rows: str = SIZES) -> DataFrame:
    """``size, nodes, vcpus, gb_ram, ccu_per_minute``; the unit is bound by CPU or memory."""
    base = values_table(
        spark, rows, "size STRING; nodes INT; node_vcpus INT; node_gb INT"
    )
    return base.selectExpr(
        "size",
        "nodes",
        "nodes * node_vcpus AS vcpus",
        "nodes * node_gb AS gb_ram",
        f"CAST(greatest(nodes * node_vcpus / {UNIT_VCPUS}, nodes * node_gb / {UNIT_GB}) AS INT)"
        " AS ccu_per_minute",
    )


def rates(spark: SparkSession, rows: str = RATES) -> DataFrame:
    return values_table(
        spark,
        rows,
        "provider STRING; vcpu_hour DOUBLE; gb_ram_hour DOUBLE; spot_discount DOUBLE; "
        "storage_gb_month DOUBLE; put_per_1k DOUBLE; get_per_1k DOUBLE; egress_gb DOUBLE; "
        "interzone_gb DOUBLE",
    )


def region_indexes(spark: SparkSession, rows: str = REGION_INDEXES) -> DataFrame:
    return values_table(spark, rows, "provider STRING; region STRING; price_index DOUBLE")


def regions(spark: SparkSession, rows: str = REGIONS) -> DataFrame:
    return values_table(spark, rows, "provider STRING; region STRING; price_index DOUBLE")


def free_tiers(spark: SparkSession, rows: str = FREE_TIERS) -> DataFrame:
    return values_table(
        spark,
        rows,
        "provider STRING; compute_hours DOUBLE; free_vcpus DOUBLE; free_gb_ram DOUBLE; "
        "free_storage_gb DOUBLE",
    )


def plans(spark: SparkSession, rows: str = PLANS) -> DataFrame:
    return values_table(
        spark,
        rows,
        "plan STRING; display_name STRING; monthly_minimum DECIMAL(12,2); "
        "commitments BOOLEAN; free_tier_bound BOOLEAN; max_warehouses INT; "
        "max_warehouse_size STRING; daily_ccu_minutes DOUBLE; monthly_ccu_minutes DOUBLE; "
        "storage_gb DOUBLE; monthly_ingest_gb DOUBLE; daily_task_minutes DOUBLE; "
        "max_concurrent_queries INT; max_users INT; retention_days INT",
    )


def fee_bands(spark: SparkSession, rows: str = FEE_BANDS) -> DataFrame:
    return values_table(
        spark,
        rows,
        "plan STRING; from_usd DECIMAL(12,2); to_usd DECIMAL(12,2); fee_rate DECIMAL(6,4)",
    )


def addons(spark: SparkSession, rows: str = ADDONS) -> DataFrame:
    return values_table(
        spark, rows, "plan STRING; meter STRING; included DECIMAL(18,6); unit_price DECIMAL(8,4)"
    )


def commitment_tiers(spark: SparkSession, rows: str = COMMITMENT_TIERS) -> DataFrame:
    return values_table(spark, rows, "term_months INT; discount DECIMAL(6,4)")


def credit_tiers(spark: SparkSession, rows: str = CREDIT_TIERS) -> DataFrame:
    return values_table(spark, rows, "from_usd DECIMAL(12,2); bonus DECIMAL(6,4)")


def platform_prices(spark: SparkSession, rows: str = PLATFORM_PRICES) -> DataFrame:
    return values_table(spark, rows, "platform STRING; usd_per_ccu_hour DOUBLE")


def meters(spark: SparkSession, rows: str = METERS) -> DataFrame:
    return values_table(spark, rows, "meter STRING; unit STRING")
