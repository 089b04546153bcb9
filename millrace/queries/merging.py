"""Incremental scans and keyed merges over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.identifiers import slugify
from millrace.operators.conform import union_evolved
from millrace.operators.merge import high_water, last_wins, merge_frames, since
from millrace.operators.partitioning import with_partitions
from millrace.plans.sync import json_bytes
from millrace.queries import query
from millrace.queries.inputs import table

CURSOR = "1998-01-01"


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").cast("decimal(18,4)").alias("price"),
        F.col("o_orderdate").alias("changed_at"),
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: one record per line (many per order) and a new order per finished one."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_suppkey").alias("o_custkey"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("price"),
        F.col("l_shipdate").alias("changed_at"),
    )
    new = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"),
        "o_custkey",
        F.col("o_totalprice").cast("decimal(18,4)").alias("price"),
        F.col("o_orderdate").alias("changed_at"),
    )
    return lines.unionByName(new)


SQL_TARGET = """target AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,4)) AS price,
    o_orderdate AS changed_at FROM orders)"""
SQL_CHANGES = """changes AS (
    SELECT l_orderkey AS o_orderkey, l_suppkey AS o_custkey,
           CAST(l_extendedprice AS DECIMAL(18,4)) AS price, l_shipdate AS changed_at FROM lineitem
    UNION ALL
    SELECT -o_orderkey - 1, o_custkey, CAST(o_totalprice AS DECIMAL(18,4)), o_orderdate
    FROM orders WHERE o_orderstatus = 'F')"""
SQL_NEWEST = """newest AS (
    SELECT o_orderkey, o_custkey, price, changed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey
               ORDER BY changed_at DESC, o_custkey DESC, price DESC) AS rn FROM changes) WHERE rn = 1)"""


@query(f"SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{CURSOR}'")
def incremental_scan_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(table(spark, sf_dir, "orders"), "o_orderdate", CURSOR)


@query(f"SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{CURSOR}'")
def incremental_scan_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(table(spark, sf_dir, "orders"), "o_orderdate", CURSOR, inclusive=False)


@query(
    """SELECT 'o_orderdate' AS cursor_column, 'timestamp_ntz' AS cursor_type,
              max(o_orderdate) AS cursor_value FROM orders"""
)
def cursor_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_water(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"WITH {SQL_CHANGES}, {SQL_NEWEST} SELECT * FROM newest")
def batch_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(order_changes(spark, sf_dir), ["o_orderkey"], ["changed_at"])


#: The rows after an upsert: per key the newest change, or else the stored row.  One ranking, no join.
SQL_UPSERTED = f"""WITH {SQL_TARGET}, {SQL_CHANGES}, versions AS (
      SELECT *, 0 AS incoming FROM target UNION ALL SELECT *, 1 FROM changes)
    SELECT o_orderkey, o_custkey, price, changed_at FROM versions
    QUALIFY row_number() OVER (PARTITION BY o_orderkey
      ORDER BY incoming DESC, changed_at DESC, o_custkey DESC, price DESC) = 1"""


@query(SQL_UPSERTED)
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_frames(
        target_orders(spark, sf_dir), order_changes(spark, sf_dir), ["o_orderkey"], ["changed_at"]
    )


def _without_key(df: DataFrame) -> DataFrame:
    """A third of the keys missing: the orders of one status level of price."""
    return df.withColumn("o_orderkey", F.when(F.col("price") > 100000, F.col("o_orderkey")))


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES},
    t AS (SELECT CASE WHEN price > 100000 THEN o_orderkey END AS o_orderkey, o_custkey, price, changed_at FROM target),
    c AS (SELECT CASE WHEN price > 100000 THEN o_orderkey END AS o_orderkey, o_custkey, price, changed_at FROM changes),
    n AS (SELECT o_orderkey, o_custkey, price, changed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey
               ORDER BY changed_at DESC, o_custkey DESC, price DESC) AS rn FROM c) WHERE rn = 1)
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_orderkey IS NOT DISTINCT FROM t.o_orderkey)
    UNION ALL SELECT * FROM n"""
)
def upsert_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing keys are equal to each other; most rows share that one key."""
    return merge_frames(
        _without_key(target_orders(spark, sf_dir)),
        _without_key(order_changes(spark, sf_dir)),
        ["o_orderkey"],
        ["changed_at"],
    )


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES},
    t AS (SELECT CASE WHEN price > 100000 THEN o_orderkey END AS o_orderkey, o_custkey, price, changed_at FROM target),
    c AS (SELECT CASE WHEN price > 100000 THEN o_orderkey END AS o_orderkey, o_custkey, price, changed_at FROM changes),
    versions AS (SELECT *, 0 AS incoming FROM t UNION ALL SELECT *, 1 FROM c)
    SELECT o_orderkey, o_custkey, price, changed_at FROM versions WHERE o_orderkey IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY o_orderkey
      ORDER BY incoming DESC, changed_at DESC, o_custkey DESC, price DESC) = 1
    UNION ALL SELECT o_orderkey, o_custkey, price, changed_at FROM versions WHERE o_orderkey IS NULL"""
)
def merge_sql_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the rules of SQL MERGE: a missing key never matches."""
    return merge_frames(
        _without_key(target_orders(spark, sf_dir)),
        _without_key(order_changes(spark, sf_dir)),
        ["o_orderkey"],
        ["changed_at"],
        null_safe=False,
    )


@query("SELECT o_custkey FROM orders UNION ALL SELECT DISTINCT c_custkey FROM customer "
       "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is all key only gains the keys it lacks."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    held = table(spark, sf_dir, "orders").select("o_custkey")
    return merge_frames(held, customers, ["o_custkey"], null_safe=False)


@query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,4)) AS price, "
       "o_orderdate AS changed_at FROM orders")
def boundary_replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to the cursor, then all from the cursor on: the boundary day comes twice."""
    orders = target_orders(spark, sf_dir)
    held = orders.filter(F.col("changed_at") <= F.lit(CURSOR).cast("timestamp_ntz"))
    return merge_frames(held, since(orders, "changed_at", CURSOR), ["o_orderkey"], ["changed_at"])


@query(
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, NULL AS quantity FROM orders
    UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), l_quantity FROM lineitem"""
)
def evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")
    )
    new = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("quantity"),
    )
    return union_evolved([old, new])


@query(
    """SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS o_orderdate_year,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate_month, count(*) AS orders
    FROM orders GROUP BY 1, 2"""
)
def partition_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = with_partitions(table(spark, sf_dir, "orders"), ["years(o_orderdate)", "month(o_orderdate)"])
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("orders"))


@query(
    """SELECT CAST(ts AS DATE) AS ts_day, strftime(ts, '%Y-%m-%d-%H') AS ts_hour, event_type,
              count(*) AS events FROM events GROUP BY 1, 2, 3"""
)
def partition_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = with_partitions(
        table(spark, sf_dir, "events"), ["days(ts)", "hours(ts)", "identity(event_type)"]
    )
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("events"))


@query(
    """SELECT o_orderkey - o_orderkey % 100 AS o_orderkey_trunc,
              substr(o_orderpriority, 1, 3) AS o_orderpriority_trunc, count(*) AS orders
    FROM orders GROUP BY 1, 2"""
)
def partition_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = with_partitions(
        table(spark, sf_dir, "orders"), ["truncate(100, o_orderkey)", "truncate(o_orderpriority, 3)"]
    )
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("orders"))


@query(
    """WITH s AS (
      SELECT p_brand || ' / ' || p_type || ': ' || p_name AS name,
             trim(regexp_replace(lower(p_brand || ' / ' || p_type || ': ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug
      FROM part
      UNION ALL
      SELECT p_size || '" ' || p_name, trim(regexp_replace(lower(p_size || '" ' || p_name), '[^a-z0-9]+', '_', 'g'), '_')
      FROM part)
    SELECT name, CASE WHEN regexp_matches(slug, '^[0-9]') THEN 't_' || slug ELSE slug END AS table_name FROM s"""
)
def table_name_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat("p_brand", F.lit(" / "), "p_type", F.lit(": "), "p_name")
    sized = F.concat(F.col("p_size").cast("string"), F.lit('" '), F.col("p_name"))
    names = part.select(name.alias("name")).unionAll(part.select(sized.alias("name")))
    return names.select("name", slugify(F.col("name")).alias("table_name"))


@query(
    """SELECT count(*) AS rows, CAST(sum(length(CAST(to_json(struct_pack(
         event_id := event_id, user_id := user_id, event_type := event_type, value := value,
         props := props)) AS VARCHAR))) AS BIGINT) AS json_bytes FROM events"""
)
def batch_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_bytes(
        table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    )
