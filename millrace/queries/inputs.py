"""The test tables seen as the tables this library works on.

Tenants are customers (``c<key>``) and their plan follows the market segment.
Usage is the event log: the event type is the meter, the user the tenant.
Every mapping exists twice, as DataFrame code and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dims
from millrace.usage import metering, summary

AS_OF = "2024-01-16 12:00:00"
JANUARY = ("2024-01-01", "2024-02-01")


#: The tables' columns, declared so that no job has to look into the files first.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def choose(column: Column, choices: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for key, value in reversed(choices.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def sql_choose(column: str, choices: dict[str, str], default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items())
    other = "NULL" if default is None else f"'{default}'"
    return f"CASE {column} {whens} ELSE {other} END"


METER_OF = {
    "view": dims.COMPUTE,
    "click": dims.STORAGE,
    "purchase": dims.INGEST,
    "signup": dims.TASKS,
    "error": dims.EGRESS,
}
RESOURCE_OF = {"view": "warehouse", "click": "table", "purchase": "pipeline", "signup": "run"}
PLAN_OF = {
    "AUTOMOBILE": "trial",
    "BUILDING": "team",
    "FURNITURE": "business",
    "HOUSEHOLD": "enterprise",
}
SIZE_NAMES = ["xs", "s", "m", "l", "xl", "2xl", "3xl", "4xl"]
PROVIDERS = ["aws", "azure", "gcp", "tencent", "alibaba", "generic", "local"]


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as usage without unit costs."""
    return usage_log_of(table(spark, sf_dir, "events"))


def usage_log_of(e: DataFrame) -> DataFrame:
    """The same of any frame of events, a stream too."""
    user = F.col("user_id")
    aws = user % 3 == 0
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("c"), user).alias("tenant_id"),
        F.concat(F.lit("ws_"), F.col("event_id") % 3).alias("workspace_id"),
        choose(F.col("event_type"), METER_OF).alias("meter"),
        (F.col("value").cast("decimal(18,2)") * 25).cast("decimal(20,9)").alias("quantity"),
        F.col("ts").alias("occurred_at"),
        choose(F.col("event_type"), RESOURCE_OF).alias("resource_type"),
        F.concat(F.lit("r"), F.regexp_extract("props", "[0-9]+", 0)).alias("resource_id"),
        F.when(aws, F.lit("aws")).when(user % 3 == 1, F.lit("tencent")).otherwise(F.lit("gcp")).alias("provider"),
        F.when(
            aws, F.when(user % 2 == 0, F.lit("ap-southeast-1")).otherwise(F.lit("us-east-1"))
        ).alias("region"),
        (user % 5 == 0).alias("spot"),
    )


SQL_USAGE_LOG = f"""
  SELECT CAST(event_id AS VARCHAR) AS id, 'c' || user_id AS tenant_id,
         'ws_' || (event_id % 3) AS workspace_id,
         {sql_choose('event_type', METER_OF)} AS meter,
         CAST(CAST(value AS DECIMAL(18,2)) * 25 AS DECIMAL(20,9)) AS quantity,
         ts AS occurred_at, {sql_choose('event_type', RESOURCE_OF)} AS resource_type,
         'r' || regexp_extract(props, '[0-9]+') AS resource_id,
         CASE user_id % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'tencent' ELSE 'gcp' END AS provider,
         CASE WHEN user_id % 3 = 0 THEN
           CASE user_id % 2 WHEN 0 THEN 'ap-southeast-1' ELSE 'us-east-1' END END AS region,
         user_id % 5 = 0 AS spot
  FROM events
"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.with_unit_cost(
        usage_log(spark, sf_dir), dims.rates(spark), dims.region_indexes(spark), strict=True
    )


def sql_dim(name: str, rows: str, columns: str) -> str:
    """A constant dimension as a CTE; columns are ``name TYPE`` pairs."""
    pairs = [c.strip().split(" ", 1) for c in columns.split(";")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in pairs)
    return f"{name} AS (SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(n for n, _ in pairs)}))"


SQL_RATES = sql_dim(
    "rates",
    dims.RATES,
    "provider VARCHAR; vcpu_hour DOUBLE; gb_ram_hour DOUBLE; spot_discount DOUBLE; "
    "storage_rate DOUBLE; put_per_1k DOUBLE; get_per_1k DOUBLE; egress_rate DOUBLE; "
    "interzone_gb DOUBLE",
)
SQL_INDEXES = sql_dim(
    "indexes", dims.REGION_INDEXES, "provider VARCHAR; region VARCHAR; price_index DOUBLE"
)
SQL_SIZES = (
    sql_dim("size_rows", dims.SIZES, "size VARCHAR; nodes INT; node_vcpus INT; node_gb INT")
    + ", sizes AS (SELECT size, nodes * node_vcpus AS vcpus, nodes * node_gb AS gb_ram, "
    "greatest(nodes * node_vcpus, nodes * node_gb // 4) AS ccu FROM size_rows)"
)

#: CTEs up to ``usage`` (events with unit cost) and ``summary``.
SQL_USAGE = f"""
  WITH {SQL_RATES}, {SQL_INDEXES},
  log AS ({SQL_USAGE_LOG}),
  rated AS (
    SELECT l.*, coalesce(i.price_index, 1.0::DOUBLE) AS idx, r.vcpu_hour, r.gb_ram_hour,
           r.spot_discount, r.storage_rate, r.put_per_1k, r.egress_rate
    FROM log l LEFT JOIN rates r ON r.provider = l.provider
    LEFT JOIN indexes i ON i.provider = l.provider AND i.region = l.region
  ),
  usage AS (
    SELECT id, tenant_id, workspace_id, meter, quantity, occurred_at, resource_type, resource_id,
      provider, region, spot,
      CAST(CASE meter
        WHEN '{dims.COMPUTE}' THEN (1 * (vcpu_hour * idx) + 4 * (gb_ram_hour * idx))
             * CASE WHEN spot THEN 1.0::DOUBLE - spot_discount ELSE 1.0::DOUBLE END / 60.0::DOUBLE
        WHEN '{dims.STORAGE}' THEN storage_rate * idx
        WHEN '{dims.INGEST}' THEN 0.008::DOUBLE * put_per_1k
        WHEN '{dims.TASKS}' THEN (1 * (vcpu_hour * idx) + 2 * (gb_ram_hour * idx))
             * CASE WHEN spot THEN 1.0::DOUBLE - spot_discount ELSE 1.0::DOUBLE END / 60.0::DOUBLE
        WHEN '{dims.EGRESS}' THEN egress_rate ELSE 0 END AS DECIMAL(16,12)) AS unit_cost_usd
    FROM rated
  ),
  summary AS (
    SELECT tenant_id, CAST(date_trunc('month', occurred_at) AS DATE) AS period_start, meter,
      CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity,
      CAST(sum(quantity * unit_cost_usd) AS DECIMAL(24,8)) AS infra_cost_usd,
      count(*) AS events
    FROM usage GROUP BY 1, 2, 3
  )
"""


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarize(usage_events(spark, sf_dir), providers=False).drop("events")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per customer: plan, provider, term, prepaid credit and spending cap."""
    c = table(spark, sf_dir, "customer")
    providers = F.array(*[F.lit(p) for p in PROVIDERS])
    terms = F.array(F.lit(0), F.lit(12), F.lit(36), F.lit(24))
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("tenant_id"),
        choose(F.col("c_mktsegment"), PLAN_OF, "community").alias("plan"),
        F.get(providers, F.col("c_nationkey") % 7).alias("provider"),
        F.get(terms, F.col("c_nationkey") % 4).alias("term_months"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(24,8)").alias("credits_balance_usd"),
    )


SQL_ACCOUNTS = f"""accounts AS (
    SELECT 'c' || c_custkey AS tenant_id,
      {sql_choose('c_mktsegment', PLAN_OF, 'community')} AS plan,
      CASE c_nationkey % 7 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' WHEN 2 THEN 'gcp'
        WHEN 3 THEN 'tencent' WHEN 4 THEN 'alibaba' WHEN 5 THEN 'generic' ELSE 'local' END AS provider,
      CASE c_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 36 ELSE 24 END AS term_months,
      CAST(greatest(c_acctbal, 0.0::DOUBLE) AS DECIMAL(24,8)) AS credits_balance_usd
    FROM customer)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as queries: seconds from the value, size and cluster count from the user."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    sizes = F.array(*[F.lit(s) for s in SIZE_NAMES])
    user = F.col("user_id")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").cast("string").alias("query_id"),
        F.concat(F.lit("c"), user).alias("tenant_id"),
        F.concat(F.lit("w"), user).alias("warehouse_id"),
        F.get(sizes, (user % 8).cast("int")).alias("size"),
        ((user % 2) * 2).cast("int").alias("min_clusters"),
        (user % 5 == 0).alias("spot"),
        (F.col("value") / 30).alias("wall_seconds"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.lit(0.0)).alias("warehouse_seconds"),
        (F.col("value").cast("decimal(18,2)") * 1_000_000_000).cast("bigint").alias("bytes_scanned"),
        (F.col("event_id") % 7 == 0).alias("cache_hit"),
        F.when(user % 3 == 0, F.lit("aws")).otherwise(F.lit("tencent")).alias("provider"),
        F.lit(None).cast("string").alias("region"),
        F.col("ts").alias("occurred_at"),
    )


SQL_QUERY_LOG = """query_log AS (
    SELECT CAST(event_id AS VARCHAR) AS query_id, 'c' || user_id AS tenant_id,
      'w' || user_id AS warehouse_id,
      CASE user_id % 8 WHEN 0 THEN 'xs' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'l'
        WHEN 4 THEN 'xl' WHEN 5 THEN '2xl' WHEN 6 THEN '3xl' ELSE '4xl' END AS size,
      (user_id % 2) * 2 AS min_clusters, user_id % 5 = 0 AS spot, value / 30 AS wall_seconds,
      CASE event_id % 2 WHEN 0 THEN value ELSE 0.0 END AS warehouse_seconds,
      CAST(CAST(value AS DECIMAL(18,2)) * 1000000000 AS BIGINT) AS bytes_scanned,
      event_id % 7 = 0 AS cache_hit,
      CASE user_id % 3 WHEN 0 THEN 'aws' ELSE 'tencent' END AS provider, ts AS occurred_at
    FROM events WHERE event_type = 'view')"""
