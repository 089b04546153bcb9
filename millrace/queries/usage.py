"""Metering and usage summaries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dims
from millrace.operators.running import idle_sessions as sessions_of
from millrace.queries import query
from millrace.queries import inputs as I
from millrace.usage import metering, summary

IDLE_SECONDS = 3600


@query(
    f"""{I.SQL_USAGE} SELECT id, tenant_id, workspace_id, meter, quantity, occurred_at, resource_type,
      resource_id, provider, region, unit_cost_usd FROM usage"""
)
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.usage_events(spark, sf_dir).drop("spot")


@query(
    f"""{I.SQL_USAGE} SELECT s.*, p.providers FROM summary s JOIN (
      SELECT tenant_id, CAST(date_trunc('month', occurred_at) AS DATE) AS period_start, meter,
             list_sort(list(DISTINCT provider)) AS providers FROM usage GROUP BY 1, 2, 3) p
      USING (tenant_id, period_start, meter)"""
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.summarize(I.usage_events(spark, sf_dir))
    return out.withColumn("period_start", F.to_date("period_start"))


@query(
    f"""{I.SQL_USAGE}, r AS (
      SELECT tenant_id, coalesce(resource_type, 'resource') || ':' || resource_id AS resource,
             CAST(sum(quantity * unit_cost_usd) AS DECIMAL(24,8)) AS infra_cost_usd
      FROM usage WHERE resource_id <> '' GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY tenant_id ORDER BY infra_cost_usd DESC, resource) AS rank FROM r) WHERE rank <= 10"""
)
def usage_by_resource_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_resource(I.usage_events(spark, sf_dir))


@query(
    f"""{I.SQL_USAGE} SELECT tenant_id, workspace_id, meter,
      CAST(grouping(tenant_id, workspace_id, meter) AS INTEGER) AS level,
      CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity,
      CAST(sum(quantity * unit_cost_usd) AS DECIMAL(24,8)) AS infra_cost_usd
    FROM usage GROUP BY ROLLUP (tenant_id, workspace_id, meter)"""
)
def usage_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.chargeback(I.usage_events(spark, sf_dir))


@query(
    f"""WITH log AS ({I.SQL_USAGE_LOG})
    SELECT tenant_id, meter, CAST(occurred_at AS DATE) AS period_start,
           CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity FROM log GROUP BY 1, 2, 3"""
)
def usage_totals_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.totals(I.usage_log(spark, sf_dir))
    return out.withColumn("period_start", F.to_date("period_start"))


@query(
    f"""WITH log AS ({I.SQL_USAGE_LOG})
    SELECT id, tenant_id, meter, quantity, occurred_at FROM log
    WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-15'
      AND meter = '{dims.COMPUTE}' AND workspace_id = 'ws_1'"""
)
def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open period, one meter, one workspace."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-08", "2024-01-15"))
    kept = summary.usage_between(
        I.usage_log(spark, sf_dir), start, end, meter=dims.COMPUTE, workspace="ws_1"
    )
    return kept.select("id", "tenant_id", "meter", "quantity", "occurred_at")


@query(
    f"""WITH log AS ({I.SQL_USAGE_LOG})
    SELECT id, tenant_id, meter, quantity, occurred_at FROM (
      SELECT * FROM log ORDER BY occurred_at DESC, id DESC LIMIT 100)"""
)
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = summary.last_events(I.usage_log(spark, sf_dir), 100)
    return newest.select("id", "tenant_id", "meter", "quantity", "occurred_at")


@query(
    f"""WITH {I.SQL_SIZES}, {I.SQL_QUERY_LOG}
    SELECT q.query_id AS id, q.tenant_id, q.warehouse_id AS resource_id, q.occurred_at,
      CAST(CAST(CAST(greatest(CASE WHEN warehouse_seconds > 0 THEN warehouse_seconds ELSE wall_seconds END, 1.0)
                     AS DECIMAL(18,6)) * (s.ccu * greatest(min_clusters, 1)) AS DOUBLE) / 60.0::DOUBLE
           AS DECIMAL(20,9)) AS quantity
    FROM query_log q JOIN sizes s USING (size) WHERE NOT cache_hit"""
)
def query_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metering.meter_queries(I.query_log(spark, sf_dir), dims.sizes(spark))
    return out.select("id", "tenant_id", "resource_id", "occurred_at", "quantity")


@query(
    """SELECT 'c' || user_id AS tenant_id, ts AS occurred_at, CAST(
      CAST(CAST(CAST(value AS DECIMAL(18,2)) * 1000000000 AS DECIMAL(20,0)) * 1 AS DOUBLE)
        / CAST(date_diff('hour', date_trunc('month', ts), date_trunc('month', ts) + INTERVAL 1 MONTH) * 1000000000 AS DOUBLE)
      AS DECIMAL(20,9)) AS quantity
    FROM events WHERE event_type = 'click'"""
)
def storage_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as hourly size samples."""
    e = I.table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    samples = e.select(
        F.concat(F.lit("c"), "user_id").alias("tenant_id"),
        (F.col("value").cast("decimal(18,2)") * 1_000_000_000).alias("bytes_stored"),
        F.lit(1.0).alias("window_hours"),
        F.lit(None).cast("string").alias("table_name"),
        F.col("ts").alias("occurred_at"),
    )
    return metering.meter_storage(samples).select("tenant_id", "occurred_at", "quantity")


@query(
    """SELECT 'c' || user_id AS tenant_id, meter, count(*) AS events, CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity
    FROM (
      SELECT user_id, 'ingest_gb' AS meter, CAST(CAST(CAST(value AS DECIMAL(18,2)) * 1000000 AS DOUBLE) / 1e9 AS DECIMAL(20,9)) AS quantity
      FROM events WHERE event_type = 'purchase'
      UNION ALL
      SELECT user_id, 'orchestration_task_minute', CAST(CAST(CAST(value AS DECIMAL(18,6)) AS DOUBLE) / 60 AS DECIMAL(20,9))
      FROM events WHERE event_type = 'signup'
      UNION ALL
      SELECT user_id, 'egress_gb', CAST(CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DOUBLE) / 1e9 AS DECIMAL(20,9))
      FROM events WHERE event_type = 'error'
      UNION ALL SELECT user_id, 'api_request', 1 FROM events)
    WHERE quantity > 0 GROUP BY 1, 2"""
)
def other_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncs, tasks, exports and calls, each from the log of its kind."""
    e = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), "user_id").alias("tenant_id"),
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("v"),
        F.col("ts").alias("occurred_at"),
        F.col("event_id").cast("string").alias("key"),
    )
    kind = F.col("event_type")
    syncs = e.filter(kind == "purchase").select(
        "tenant_id", "occurred_at", (F.col("v") * 1_000_000).alias("bytes_moved"),
        F.lit(1).alias("records"), F.col("key").alias("source"),
    )
    tasks = e.filter(kind == "signup").select(
        "tenant_id", "occurred_at", F.col("v").alias("seconds"), F.col("key").alias("run_id"),
        F.lit("build").alias("task"),
    )
    exports = e.filter(kind == "error").select(
        "tenant_id", "occurred_at", (F.col("v") * 1_000).alias("bytes_out")
    )
    rows = (
        metering.meter_syncs(syncs)
        .unionByName(metering.meter_tasks(tasks))
        .unionByName(metering.meter_egress(exports))
        .unionByName(metering.meter_calls(e))
    )
    return rows.groupBy("tenant_id", "meter").agg(
        F.count(F.lit(1)).alias("events"), F.sum("quantity").cast("decimal(20,9)").alias("quantity")
    )


SQL_SESSIONS = f"""marked AS (
    SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))
        < {IDLE_SECONDS * 1_000_000} THEN 0 ELSE 1 END AS opens FROM events),
  numbered AS (
    SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM marked),
  sessions AS (
    SELECT user_id, session, min(ts) AS started_at, max(ts) AS last_activity_at, count(*) AS activities
    FROM numbered GROUP BY 1, 2)"""


@query(f"WITH {SQL_SESSIONS} SELECT * FROM sessions")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_of(I.table(spark, sf_dir, "events"), ["user_id"], "ts", IDLE_SECONDS)


@query(
    f"""WITH {SQL_SESSIONS}, {I.SQL_SIZES}
    SELECT 'c' || user_id AS tenant_id, last_activity_at AS occurred_at, CAST(
      CAST(CAST(least((epoch_us(last_activity_at) - epoch_us(started_at)) / 1e6, 60.0) AS DECIMAL(18,6)) * s.ccu AS DOUBLE)
        / 60.0::DOUBLE AS DECIMAL(20,9)) AS quantity
    FROM sessions JOIN sizes s ON s.size = CASE user_id % 8 WHEN 0 THEN 'xs' WHEN 1 THEN 's' WHEN 2 THEN 'm'
      WHEN 3 THEN 'l' WHEN 4 THEN 'xl' WHEN 5 THEN '2xl' WHEN 6 THEN '3xl' ELSE '4xl' END
    WHERE last_activity_at > started_at"""
)
def idle_uptime_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to a minute of uptime per stretch of activity; one event alone has none."""
    stretches = sessions_of(I.table(spark, sf_dir, "events"), ["user_id"], "ts", IDLE_SECONDS)
    sizes = F.array(*[F.lit(s) for s in I.SIZE_NAMES])
    ready = stretches.select(
        "*",
        F.get(sizes, (F.col("user_id") % 8).cast("int")).alias("size"),
        F.concat(F.lit("c"), "user_id").alias("tenant_id"),
        F.concat(F.lit("w"), "user_id").alias("warehouse_id"),
    )
    out = metering.meter_idle(ready, dims.sizes(spark))
    return out.select("tenant_id", "occurred_at", "quantity")
