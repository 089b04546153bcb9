"""Run logs, checkpoints, schedules, ids and messages derived from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from millrace.functions import identifiers, temporal
from millrace.operators import calendar
from millrace.operators.once import computed_once
from millrace.plans.sync import latest_checkpoints, records_per_run
from millrace.plans.sync import run_rollup as rollup_runs
from millrace.queries import inputs as I
from millrace.queries import query
from millrace.schema import make_schema
from millrace.session import scratch_path
from millrace.sources import protocol
from millrace.sources.files import explode_records
from millrace.sources.relational import describe_streams


# ------------------------------------------------------------------------- runs


@query(
    """SELECT 'run_' || user_id || '_' || strftime(ts, '%Y%m%d') AS run_id, count(*) AS tasks,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS records_synced,
      count(*) FILTER (WHERE event_type = 'view') AS models_built,
      CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'succeeded' END AS status
    FROM events GROUP BY 1"""
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a run, its events as tasks."""
    e = I.table(spark, sf_dir, "events")
    tasks = e.select(
        F.concat(F.lit("run_"), "user_id", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        I.choose(F.col("event_type"), {"purchase": "ingest", "view": "transform"}, "maintenance").alias("kind"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.floor("value").alias("records"),
    )
    return rollup_runs(tasks)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS records,
       CAST(sum(length(props)) AS BIGINT) AS bytes_moved, bool_and(event_type <> 'error') AS succeeded
    FROM events GROUP BY 1"""
)
def sync_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = I.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.floor("value").alias("records"),
        F.length("props").alias("bytes_moved"),
        (F.col("event_type") != "error").alias("succeeded"),
    )
    return records_per_run(log)


@query(
    """SELECT source, stream, cursor_column, cursor_type, cursor_value, run_id, committed_at FROM (
      SELECT 'u' || user_id AS source, event_type AS stream, 'event_id' AS cursor_column,
        'bigint' AS cursor_type, CAST(event_id AS VARCHAR) AS cursor_value,
        CAST(event_id AS VARCHAR) AS run_id, ts AS committed_at,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn
      FROM events) WHERE rn = 1"""
)
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of a user's streams."""
    log = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("source"),
        F.col("event_type").alias("stream"),
        F.lit("event_id").alias("cursor_column"),
        F.lit("bigint").alias("cursor_type"),
        F.col("event_id").cast("string").alias("cursor_value"),
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("committed_at"),
    )
    return latest_checkpoints(log)


# -------------------------------------------------------------------- schedules

#: A schedule per customer by market segment.
SCHEDULES = {
    "AUTOMOBILE": "0 2 * * *",
    "BUILDING": "every 12 hours",
    "FURNITURE": "30 6,18 1,15 * mon",
    "HOUSEHOLD": "@weekly",
    "MACHINERY": "0 9-17/4 * jan 1-5",
}
SQL_SCHEDULES = "schedules AS (SELECT 'c' || c_custkey AS tenant_id, c_mktsegment FROM customer)"
SQL_SPAN = "SELECT min(ts) AS lo, max(ts) AS hi FROM events"
# Each schedule as a predicate over the minutes of the log.
SQL_FIRINGS = f"""{SQL_SCHEDULES},
  span AS ({SQL_SPAN}),
  minutes AS (SELECT unnest(generate_series(date_trunc('minute', lo), hi, INTERVAL 1 MINUTE)) AS m FROM span),
  timed AS (SELECT m, minute(m) AS mi, hour(m) AS h, day(m) AS d, month(m) AS mo, dayofweek(m) AS w
    FROM minutes, span WHERE m >= lo AND m < hi),
  kinds AS (
    SELECT 'AUTOMOBILE' AS seg, m FROM timed WHERE mi = 0 AND h = 2
    UNION ALL SELECT 'BUILDING', m FROM timed WHERE mi = 0 AND h IN (0, 12)
    UNION ALL SELECT 'FURNITURE', m FROM timed WHERE mi = 30 AND h IN (6, 18) AND (d IN (1, 15) OR w = 1)
    UNION ALL SELECT 'HOUSEHOLD', m FROM timed WHERE mi = 0 AND h = 0 AND w = 0
    UNION ALL SELECT 'MACHINERY', m FROM timed WHERE mi = 0 AND h IN (9, 13, 17) AND mo = 1 AND w BETWEEN 1 AND 5),
  firings AS (SELECT s.tenant_id, k.m AS fires_at FROM schedules s JOIN kinds k ON k.seg = s.c_mktsegment)"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schedule per customer, with the time span of the event log."""
    c = I.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("tenant_id"),
        I.choose(F.col("c_mktsegment"), SCHEDULES).alias("cron"),
    )
    span = I.table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return c.crossJoin(F.broadcast(span))


@query(f"WITH {SQL_FIRINGS} SELECT * FROM firings")
def cron_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every firing of every schedule while the log ran."""
    fired = calendar.firings(schedules(spark, sf_dir), F.col("lo"), F.col("hi"))
    return fired.select("tenant_id", "fires_at")


@query(
    f"""WITH {SQL_FIRINGS},
    last AS (SELECT 'c' || user_id AS tenant_id, max(ts) AS last_run_at FROM events GROUP BY 1),
    missed AS (
      SELECT f.tenant_id, min(fires_at) AS due_since, count(*) AS missed
      FROM firings f LEFT JOIN last l USING (tenant_id)
      WHERE fires_at <= TIMESTAMP '2024-01-30'
        AND fires_at > coalesce(last_run_at, TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR) GROUP BY 1)
    SELECT s.tenant_id, last_run_at, due_since, missed, due_since IS NOT NULL AS is_due
    FROM schedules s LEFT JOIN last USING (tenant_id) LEFT JOIN missed USING (tenant_id)"""
)
def missed_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which schedules are overdue at the start of the 30th, given the tenants' last events."""
    runs = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), "user_id").alias("tenant_id"), F.col("ts").alias("started_at")
    )
    as_of = F.lit("2024-01-30").cast("timestamp_ntz")
    plans = schedules(spark, sf_dir).drop("lo", "hi")
    out = calendar.due(plans, runs, "tenant_id", as_of)
    return out.drop("cron")


# ------------------------------------------------------------------ ids and time


@query(
    """SELECT event_id, epoch_us(ts) // 1000 AS created_ms, 'usr' AS prefix, TRUE AS valid FROM events"""
)
def id_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sortable ids built from the event times, read back."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    digits = [
        F.substring(F.lit(identifiers.BASE32), (F.shiftright(millis, 5 * i) % 32).cast("int") + 1, 1)
        for i in reversed(range(10))
    ]
    made = F.concat(F.lit("usr_"), *digits, F.lit("0123456789ABCDEF"))
    e = I.table(spark, sf_dir, "events").select("event_id", made.alias("id"))
    return e.select(
        "event_id",
        identifiers.id_timestamp_ms(F.col("id")).alias("created_ms"),
        identifiers.id_prefix(F.col("id")).alias("prefix"),
        identifiers.is_id(F.col("id"), "usr").alias("valid"),
    )


@query(
    """SELECT event_id, date_trunc('month', ts) AS month_from,
      date_trunc('month', ts) + INTERVAL 1 MONTH AS month_to, date_trunc('day', ts) AS day_from,
      date_trunc('day', ts) + INTERVAL 1 DAY AS day_to,
      CAST(date_diff('day', date_trunc('month', ts), date_trunc('month', ts) + INTERVAL 1 MONTH) * 24 AS INTEGER) AS hours,
      (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000.0 AS seconds,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso
    FROM events"""
)
def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    ntz = "timestamp_ntz"
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        temporal.month_start(ts).cast(ntz).alias("month_from"),
        temporal.month_end(ts).cast(ntz).alias("month_to"),
        temporal.day_start(ts).cast(ntz).alias("day_from"),
        temporal.day_end(ts).cast(ntz).alias("day_to"),
        temporal.hours_in_month(ts).alias("hours"),
        temporal.seconds_between(temporal.day_start(ts), ts).alias("seconds"),
        temporal.to_iso(ts).alias("iso"),
    )


@query(
    """SELECT o_orderkey,
      CASE WHEN s < 60 THEN printf('%.1fs', CAST(s AS DOUBLE)) WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60)
           ELSE printf('%dh %02dm', s // 3600, s % 3600 // 60) END AS duration,
      CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0::DOUBLE)
           WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576.0::DOUBLE)
           WHEN b < 1099511627776 THEN printf('%.1fGB', b / 1073741824.0::DOUBLE)
           ELSE printf('%.1fTB', b / 1099511627776.0::DOUBLE) END AS size
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 40) AS BIGINT) AS s,
                 CAST(floor(o_totalprice) AS BIGINT) * o_custkey * o_custkey AS b FROM orders)"""
)
def human_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.col("o_totalprice") / 40)
    # Beyond four million customers the product is no BIGINT any more.
    size = F.floor("o_totalprice").cast("decimal(38,0)") * F.col("o_custkey") * F.col("o_custkey")
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        temporal.format_duration(seconds).alias("duration"),
        temporal.human_bytes(size).alias("size"),
    )


@query(
    """SELECT conv_id, turn, CASE WHEN text <> '' THEN '***' ELSE '' END AS token, role AS kept FROM conversations"""
)
def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = F.create_map(F.lit("token"), "text", F.lit("role"), "role")
    shown = identifiers.mask_secrets(config, ["token", "password"])
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", shown["token"].alias("token"), shown["role"].alias("kept")
    )


# --------------------------------------------------------------------- messages


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as record messages of two streams, between states and noise."""
    o = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.struct(F.col("o_orderstatus").alias("status")).alias("meta"),
        F.col("o_orderpriority").alias("priority"),
    )
    records = protocol.record_lines(o.drop("priority"), "orders", F.col("id"))
    other = protocol.record_lines(o.select("id"), "ids", F.lit(0), namespace="side")
    states = o.select(
        F.concat(
            F.lit('{"type":"STATE","state":{"data":{"orders":{"cursor":"'), F.col("at"),
            F.lit('"}},"stream":"orders"}}'),
        ).alias("value")
    )
    noise = o.select(
        F.when(F.col("priority").startswith("1"), F.lit("not json at all"))
        .when(F.col("priority").startswith("2"), F.lit('{"broken":'))
        .when(F.col("priority").startswith("3"), F.lit(""))
        .otherwise(F.lit('{"type":"UNHEARD_OF"}'))
        .alias("value")
    )
    lines = records.unionByName(other).unionByName(states).unionByName(noise)
    return computed_once(lines.withColumnRenamed("value", "_v"), value=F.col("_v")).select("value")


@query(
    """SELECT 'RECORD' AS type, 'orders' AS stream, CAST(NULL AS VARCHAR) AS namespace, count(*) AS messages,
              CAST(sum(o_orderkey) AS BIGINT) AS emitted FROM orders
    UNION ALL SELECT 'RECORD', 'ids', 'side', count(*), 0 FROM orders
    UNION ALL SELECT 'STATE', 'orders', NULL, count(*), NULL FROM orders"""
)
def protocol_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.parse_messages(message_lines(spark, sf_dir))
    return found.groupBy("type", "stream", "namespace").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("emitted_at").alias("emitted")
    )


@query(
    """SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS at,
              '{"status":"' || o_orderstatus || '"}' AS meta, o_orderkey AS _emitted_at FROM orders"""
)
def protocol_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one stream as typed columns."""
    schema = make_schema({"id": "long", "price": "double", "at": "timestamptz", "meta": "json"})
    found = protocol.parse_messages(message_lines(spark, sf_dir))
    out = protocol.stream_records(found, "orders", schema)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    """WITH o AS (
      SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT 'orders' AS stream, n AS records, CAST(o_orderkey AS VARCHAR) AS cursor FROM o WHERE o_orderkey % 10 = 0
      AND n < (SELECT count(*) * 3 // 4 FROM orders)"""
)
def state_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with states between its records: each commits what stands before it; the read ends at three quarters."""
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    text = F.col("o_orderkey").cast("string")
    record = F.format_string('{"type":"RECORD","record":{"stream":"orders","data":{"id":%s}}}', text)
    state = F.format_string('{"type":"STATE","state":{"stream":"orders","data":{"cursor":"%s"}}}', text)
    lines = o.select(
        "o_orderdate", "o_orderkey", F.posexplode(F.when(F.col("o_orderkey") % 10 == 0, F.array(record, state)).otherwise(F.array(record)))
    )
    path = scratch_path(spark, "state-log")
    lines.orderBy("o_orderdate", "o_orderkey", "pos").select(F.col("col").alias("value")).write.text(path)
    messages = protocol.parse_messages(protocol.read_log(spark, path), keep=["position"])
    stop = o.count() * 3 // 4
    return protocol.committed_states(messages, max_records=stop).select(
        "stream", "records", F.get_json_object("state", "$.cursor").alias("cursor")
    )


@query(
    """SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS amount FROM orders
    UNION ALL SELECT 'customer of order', o_custkey, NULL FROM orders
    UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part"""
)
def json_record_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in envelopes, as lists, as a single object or missing, found by their path."""
    orders, parts = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "part")
    two = F.expr(
        "array(named_struct('kind', 'order', 'key', o_orderkey, 'amount', o_totalprice), "
        "named_struct('kind', 'customer of order', 'key', o_custkey, 'amount', CAST(NULL AS DOUBLE)))"
    )
    one = F.expr("named_struct('kind', 'part', 'key', p_partkey, 'amount', p_retailprice)")

    def envelope(items: Column) -> Column:
        return F.to_json(F.struct(F.struct(items.alias("items")).alias("data"))).alias("value")

    texts = (
        orders.select(envelope(two))
        .unionByName(parts.select(envelope(one)))
        .unionByName(parts.select(F.lit('{"data": {}}').alias("value")))
    )
    docs = computed_once(texts, doc=F.parse_json("value")).select("doc")
    return explode_records(docs, "data.items").selectExpr(
        "variant_get(doc, '$.kind', 'string') AS kind",
        "variant_get(doc, '$.key', 'bigint') AS key",
        "variant_get(doc, '$.amount', 'double') AS amount",
    )


# -------------------------------------------------------------------- discovery


@query(
    """WITH t AS (SELECT CASE c_nationkey % 2 WHEN 0 THEN 'public' ELSE 'shop' END AS namespace, 'table_' || c_custkey AS tab, c_acctbal FROM customer)
    SELECT CASE namespace WHEN 'public' THEN tab ELSE namespace || '_' || tab END AS name, namespace,
      ['key', 'tenant', 'note', 'updated_at'] AS columns, ['key', 'tenant'] AS keys,
      CASE WHEN c_acctbal > 0 THEN 'updated_at' ELSE 'key' END AS cursor, TRUE AS incremental
    FROM t"""
)
def discovered_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of one table per customer, described as streams.

    Only some have a usable ``updated_at``; the others fall back to the first
    column that can be a cursor.
    """
    c = I.table(spark, sf_dir, "customer")
    stamp = F.when(F.col("c_acctbal") > 0, F.lit("date")).otherwise(F.lit("text"))
    described = [
        ("key", F.lit("bigint"), "NO", 1),
        ("tenant", F.lit("integer"), "NO", 2),
        ("note", F.lit("text"), "YES", None),
        ("updated_at", stamp, "YES", None),
    ]
    kinds = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(place).alias("ordinal_position"),
                kind.alias("data_type"),
                F.lit(nullable).alias("is_nullable"),
                F.lit(key).cast("int").alias("key_position"),
            )
            for place, (name, kind, nullable, key) in enumerate(described, start=1)
        ]
    )
    rows = c.select(
        F.when(F.col("c_nationkey") % 2 == 0, "public").otherwise("shop").alias("table_schema"),
        F.concat(F.lit("table_"), "c_custkey").alias("table_name"),
        F.inline(kinds),
    )
    found = describe_streams(rows)
    return found.withColumn("columns", F.transform("columns", lambda x: x["name"]))


