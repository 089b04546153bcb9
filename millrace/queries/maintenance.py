"""Table writes, compaction, statistics and streams, run for real in the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dims
from millrace.plans.lakehouse_run import run_lakehouse
from millrace.plans.models import VIEW, Model
from millrace.plans.sync import APPEND, INCREMENTAL, Stream, SyncSpec, sync
from millrace.plans.tables import Lakehouse, storage_bytes, write_json_lines
from millrace.queries import inputs as I
from millrace.queries import query
from millrace.queries.merging import SQL_UPSERTED, order_changes, target_orders
from millrace.schema import TableSpec, make_schema
from millrace.session import scratch_path
from millrace.sources.files import read_csv, read_json_lines
from millrace.streaming import ingest, late
from millrace.streaming.usage import usage_windows
from millrace.usage import metering
from millrace.usage.summary import dashboard


def new_lake(spark: SparkSession, purpose: str) -> tuple[Lakehouse, str]:
    """A lakehouse of its own in the shared scratch folder, and a namespace for it."""
    lake = Lakehouse(spark, scratch_path(spark, purpose))
    return lake, f"{purpose}_{lake.root[-8:]}"


@query(SQL_UPSERTED)
def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed write into a stored table partitioned by year: only touched years are rewritten."""
    lake, space = new_lake(spark, "upsert")
    orders = target_orders(spark, sf_dir)
    table = f"{space}.orders"
    lake.ensure(table, TableSpec(orders.schema, ("o_orderkey",), ("years(changed_at)",)))
    lake.append(table, orders)
    lake.upsert(table, order_changes(spark, sf_dir), ["o_orderkey"], ["changed_at"])
    return lake.read(table)


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'"""
)
def sync_date_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor of type DATE: the second sync reads from its checkpoint on, so no order from before the first comes."""
    lake, space = new_lake(spark, "dates")
    orders = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate")
    )
    held = orders.filter("o_orderdate BETWEEN DATE '1995-06-01' AND DATE '1998-01-01'")
    grown = iter([held, orders])
    source = {"orders": Stream("orders", lambda: next(grown), ("o_orderkey",), "o_orderdate")}
    for _ in range(2):
        sync(
            spark, "shop", source, [SyncSpec("orders", INCREMENTAL)], space, lake,
            state_namespace=f"{space}_state",
        )
    return lake.read(f"{space}.orders")


@query(
    """SELECT o_orderkey, o_totalprice, date_trunc('year', o_orderdate) AS year FROM orders"""
)
def sync_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped syncs of a cursor with far more ties than the cap: every one moves on a year."""
    lake, space = new_lake(spark, "capped")
    orders = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice",
        F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("year"),
    )
    source = {"orders": Stream("orders", lambda: orders, ("o_orderkey",), "year")}
    spec = SyncSpec("orders", INCREMENTAL, max_records=10)
    years = orders.agg(F.count_distinct("year")).first()[0]
    for _ in range(years):
        sync(spark, "shop", source, [spec], space, lake, state_namespace=f"{space}_state")
    return lake.read(f"{space}.orders")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def sync_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two incremental syncs: the orders up to 1998, then whatever is new by the checkpoint."""
    lake, space = new_lake(spark, "sync")
    orders = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    grown = iter([orders.filter("o_orderdate < TIMESTAMP_NTZ '1998-01-01'"), orders])
    source = {"orders": Stream("orders", lambda: next(grown), ("o_orderkey",), "o_orderdate")}
    for _ in range(2):
        sync(
            spark, "shop", source, [SyncSpec("orders", INCREMENTAL)], space, lake,
            state_namespace=f"{space}_state",
        )
    return lake.read(f"{space}.orders")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def compact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small files per partition, rewritten as one each; the rows stay."""
    lake, space = new_lake(spark, "compact")
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    table = f"{space}.orders"
    lake.ensure(table, TableSpec(orders.schema, ("o_orderkey",), ("o_orderstatus",)))
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        one = I.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == priority)
        lake.append(table, one)
    lake.compact(table)
    return lake.read(table)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def append_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a table partitioned by bucket and status; a row that comes twice is there twice."""
    lake, space = new_lake(spark, "append")
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = f"{space}.orders"
    lake.ensure(table, TableSpec(orders.schema, (), ("bucket(4, o_orderkey)", "o_orderstatus")))
    lake.append(table, orders)
    lake.append(table, orders.filter("o_orderstatus = 'O'"))
    return lake.read(table)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV files and back, the types found again from all cells."""
    path = scratch_path(spark, "csv")
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.write.option("header", True).csv(path)
    return read_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks as JSON lines and back, under a declared schema."""
    path = scratch_path(spark, "jsonl")
    talks = I.table(spark, sf_dir, "conversations")
    write_json_lines(talks, path)
    return read_json_lines(spark, path, make_schema({"conv_id": "long", "turn": "long", "role": "string", "text": "string"}))


@query(
    """SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus AS status, count(*) AS orders,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue,
      (SELECT count(*) FROM orders) AS synced
    FROM orders GROUP BY 1, 2"""
)
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run: sync, a view over the synced table, a table over the view, compaction; the table and what was synced."""
    lake, space = new_lake(spark, "run")
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    source = {"orders": Stream("orders", lambda: orders, ("o_orderkey",), "o_orderdate")}
    models = [
        Model(
            "dated",
            f"SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus AS status, "
            f"CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM {{{{ source('{space}', 'orders') }}}}",
            VIEW,
            namespace=f"{space}_models",
        ),
        Model(
            "monthly",
            "SELECT month, status, count(*) AS orders, CAST(sum(price) AS DECIMAL(28,2)) AS revenue "
            "FROM {{ ref('dated') }} GROUP BY month, status",
            namespace=f"{space}_models",
        ),
    ]
    log = run_lakehouse(spark, {"shop": (source, [SyncSpec("orders")])}, models, lake, space, compact_below=1_000_000)
    synced = log.where("kind = 'ingest' AND status = 'succeeded'").agg(F.sum("records").alias("synced"))
    built = lake.read(f"{space}_models.monthly").withColumn("month", F.col("month").cast("timestamp_ntz"))
    return built.crossJoin(F.broadcast(synced))


@query(
    """SELECT 'customer' AS table_name, count(*) AS row_count, 5 AS columns, true AS size_in_bounds FROM customer
    UNION ALL SELECT 'nation', count(*), 3, true FROM nation
    UNION ALL SELECT 'region', count(*), 2, true FROM region"""
)
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, space = new_lake(spark, "stats")
    for name in ("customer", "nation", "region"):
        df = I.table(spark, sf_dir, name)
        lake.ensure(f"{space}.{name}", TableSpec(df.schema))
        lake.append(f"{space}.{name}", df)
    # Parquet needs a byte a row at the least here, and less than 200 beside its footers.
    footers = 20_000 * F.lit(spark.sparkContext.defaultParallelism)
    bounds = F.col("size_bytes").between(F.col("row_count"), 200 * F.col("row_count") + footers)
    return lake.stats(space).withColumn("size_in_bounds", bounds).drop("size_bytes")


@query()
def storage_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under the data folder, sampled as storage and metered.  File sizes are no SQL matter."""
    held = storage_bytes(spark, sf_dir)
    sample = metering.storage_samples(
        held, "c0", F.lit(I.AS_OF).cast("timestamp_ntz")
    )
    return metering.meter_storage(sample).drop("attributes")


@query(
    f"""WITH log AS ({I.SQL_USAGE_LOG}), t AS (
      SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows)
    SELECT 2 AS tables, rows, meter, quantity FROM t CROSS JOIN (
      SELECT meter, CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity FROM log GROUP BY 1)"""
)
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        I.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(0).alias("size_bytes")
        )
        for name in ("customer", "supplier")
    ]
    totals = dashboard(parts[0].unionByName(parts[1]), I.usage_log(spark, sf_dir))
    return totals.select("tables", "rows", F.explode("usage").alias("meter", "quantity"))


# ---------------------------------------------------------------------- streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = I.table(spark, sf_dir, "events").schema
    return ingest.read_files(spark, sf_dir, schema, name_filter="events.parquet")


@query(
    f"""{I.SQL_USAGE} SELECT tenant_id, meter, date_trunc('day', occurred_at) AS period_start,
      CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity,
      CAST(sum(quantity * unit_cost_usd) AS DECIMAL(24,8)) AS infra_cost_usd, count(*) AS events
    FROM usage GROUP BY 1, 2, 3"""
)
def stream_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage kept by a stream of the event files; the change log holds the result."""
    raw = event_stream(spark, sf_dir)
    log = I.usage_log_of(raw)
    events = metering.with_unit_cost(log, dims.rates(spark), dims.region_indexes(spark))
    windows = usage_windows(events)
    path = scratch_path(spark, "stream-usage")
    ingest.log_batches(windows, f"{path}/log", f"{path}/checkpoint", "update").awaitTermination()
    out = ingest.latest(spark, f"{path}/log", ["period_start", "tenant_id", "meter"], windows.schema)
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(
    """SELECT user_id, event_id, event_type, value, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event per user, written by key as the files arrive."""
    lake, space = new_lake(spark, "stream")
    raw = event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts")
    table = f"{space}.latest_events"
    lake.ensure(table, TableSpec(raw.schema, ("user_id",)))
    checkpoint = f"{lake.root}/checkpoint"
    ingest.upsert_stream(raw, lake, table, ["user_id"], ["ts", "event_id"], checkpoint).awaitTermination()
    return lake.read(table)


#: Parts that the events' weeks are dealt into.
ARRIVALS = 4


def arrivals(spark: SparkSession, events: DataFrame, path: str):
    """Stores the events as files that come out of order: for each, its number and then the files so far lie there.

    The events are cut into parts by time; odd parts come before the even ones, so
    every second arrival brings times that the stream has long passed.
    """
    part = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (7 * 86400)) % ARRIVALS
    for n in (1, 0, 3, 2):
        events.where(part == n).write.mode("append").parquet(path)
        yield n


@query(
    f"""{I.SQL_USAGE} SELECT tenant_id, meter, date_trunc('day', occurred_at) AS period_start,
      CAST(sum(quantity) AS DECIMAL(20,9)) AS quantity,
      CAST(sum(quantity * unit_cost_usd) AS DECIMAL(24,8)) AS infra_cost_usd, count(*) AS events
    FROM usage GROUP BY 1, 2, 3"""
)
def stream_late_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage of files that arrive out of order: late events are set aside and merged afterwards."""
    path = scratch_path(spark, "stream-late")
    source = I.table(spark, sf_dir, "events")
    for _ in arrivals(spark, source, f"{path}/in"):
        log = I.usage_log_of(ingest.read_files(spark, f"{path}/in", source.schema))
        events = metering.with_unit_cost(log, dims.rates(spark), dims.region_indexes(spark))
        late.log_usage_windows(events, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    out = late.reconciled(spark, f"{path}/log", I.usage_events(spark, sf_dir))
    return out.drop("late_events").withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, ts FROM events")
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, in files out of order: what the stream drops as late is found again, once."""
    path = scratch_path(spark, "stream-seen")
    raw = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    for _ in arrivals(spark, raw.unionByName(raw), f"{path}/in"):
        stream = ingest.read_files(spark, f"{path}/in", raw.schema)
        once = ingest.without_replays(stream, ["event_id"], "ts", "1 day")
        ingest.log_batches(once, f"{path}/log", f"{path}/checkpoint").awaitTermination()
        late.log_behind(stream, "ts", "1 day", f"{path}/behind", f"{path}/behind-checkpoint").awaitTermination()
    passed = spark.read.parquet(f"{path}/log").drop("_batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = late.first_sightings(spark, f"{path}/behind", raw.schema, passed, ["event_id"])
    return passed.unionByName(found)


@query("SELECT event_id, user_id, ts FROM events")
def stream_without_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice; the stream lets each pass once."""
    raw = event_stream(spark, sf_dir).select("event_id", "user_id", "ts")
    twice = raw.unionByName(raw)
    once = ingest.without_replays(twice, ["event_id"], "ts", "40 days")
    path = scratch_path(spark, "stream-once")
    ingest.log_batches(once, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/log").drop("_batch")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
