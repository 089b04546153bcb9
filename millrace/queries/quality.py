"""Schema inference, conforming and data tests over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import cells
from millrace.functions.coerce import from_epoch
from millrace.operators import quality as Q
from millrace.operators.conform import BAD_CELLS, cell_profile, conform, json_profile
from millrace.queries import query
from millrace.queries.inputs import table
from millrace.schema import make_field, make_schema


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text cells, the way a file would carry them, with a surplus column."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("O_ORDERKEY"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("o_orderdate"),
        F.col("o_orderstatus").alias("surplus"),
    )


@query(
    """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
              CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
              CAST(o_orderdate AS DATE) AS o_orderdate, CAST(NULL AS VARCHAR) AS note FROM orders"""
)
def conform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [
            make_field("o_orderkey", "long"),
            make_field("o_custkey", "int"),
            make_field("o_totalprice", "decimal", precision=18, scale=2),
            make_field("o_orderdate", "date"),
            make_field("note", "string"),
        ]
    )
    return conform(order_text(spark, sf_dir), schema)


@query(
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              o_totalprice / 1 AS number, o_orderkey AS exact,
              CASE WHEN o_orderpriority LIKE '%-%' THEN NULL ELSE 0 END AS nothing,
              CASE WHEN o_totalprice >= 250000 THEN NULL ELSE CAST(trunc(o_totalprice) * 1000 AS INTEGER) END AS narrow
    FROM orders"""
)
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to whole numbers (truncating), numbers, and what does not fit to NULL."""
    o = table(spark, sf_dir, "orders")
    text = o.select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").alias("whole"),
        F.col("o_totalprice").cast("string").alias("number"),
        F.col("o_orderkey").cast("string").alias("exact"),
        F.col("o_orderpriority").alias("nothing"),
        # Ten thousand millions do not fit an int.
        F.when(F.col("o_totalprice") >= 250000, F.lit("10000000000"))
        .otherwise((F.floor("o_totalprice") * 1000).cast("string"))
        .alias("narrow"),
    )
    schema = make_schema(
        {"o_orderkey": "long", "whole": "long", "number": "double", "exact": "bigint",
         "nothing": "int", "narrow": "int"}
    )
    return conform(text, schema, on_error="null")


@query(
    """SELECT o_orderkey, CAST(round_even(CAST(o_totalprice AS DECIMAL(18,4)), 0) AS DECIMAL(38,0)) AS whole,
              CAST(round_even(CAST(o_totalprice AS DECIMAL(18,4)), 1) AS DECIMAL(38,1)) AS tenths,
              CAST(o_orderkey * 1000000000000 AS DECIMAL(38,9)) AS large,
              CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS DECIMAL(38,18)) AS fine, CAST(o_custkey % 100 AS DECIMAL(38,30)) AS finest
    FROM orders"""
)
def coerce_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to decimals of every scale: half to even, and room for all digits the type can hold."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,4)").cast("string")
    text = o.select(
        "o_orderkey", price.alias("whole"), price.alias("tenths"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("000000000000")).alias("large"),
        price.alias("fine"), (F.col("o_custkey") % 100).cast("string").alias("finest"),
    )
    scales = {"whole": 0, "tenths": 1, "large": 9, "fine": 18, "finest": 30}
    fields = [make_field(n, "decimal", precision=38, scale=s) for n, s in scales.items()]
    return conform(text, T.StructType([make_field("o_orderkey", "long"), *fields]))


@query(
    """SELECT event_id, event_type = 'view' AS by_word, user_id % 2 = 1 AS by_digit,
              value >= 100 AS by_letter, user_id % 3 <> 0 AS by_number,
              CAST(NULL AS BOOLEAN) AS no_truth FROM events"""
)
def coerce_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_type") == "view", F.lit("yes")).otherwise(F.lit("FALSE")).alias("by_word"),
        (F.col("user_id") % 2).cast("string").alias("by_digit"),
        F.when(F.col("value") >= 100, F.lit("t")).otherwise(F.lit("n")).alias("by_letter"),
        (F.col("user_id") % 3).alias("by_number"),
        F.col("event_type").alias("no_truth"),
    )
    kinds = {c: "boolean" for c in ("by_word", "by_digit", "by_letter", "by_number", "no_truth")}
    return conform(raw, make_schema({"event_id": "long", **kinds}), on_error="null")


@query(
    """SELECT event_id, date_trunc('second', ts) AS from_seconds, date_trunc('millisecond', ts) AS from_millis,
              CAST(ts AS DATE) AS day, ts AS from_text, ts AS wall FROM events"""
)
def coerce_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants from epoch seconds, epoch milliseconds and ISO text with excess digits."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789"))
    raw = e.select(
        "event_id",
        F.unix_seconds(at).alias("from_seconds"),
        F.unix_millis(at).alias("from_millis"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("day"),
        F.concat(iso, F.lit("Z")).alias("from_text"),
        F.concat(iso, F.lit("+07:00")).alias("wall"),
    )
    schema = make_schema(
        {"event_id": "long", "from_seconds": "timestamptz", "from_millis": "timestamptz",
         "day": "date", "from_text": "timestamptz", "wall": "timestamp"}
    )
    out = conform(raw, schema)
    zoned = ["from_seconds", "from_millis", "from_text"]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


@query(
    """WITH bad AS (
      SELECT o_orderpriority AS value, 'level' AS "column" FROM orders
      UNION ALL SELECT o_orderstatus, 'flag' FROM orders WHERE o_orderstatus <> 'F')
    SELECT "column", value, count(*) AS cells FROM bad GROUP BY 1, 2"""
)
def bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values could not be read, per column.  The status F reads as false."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_orderpriority").alias("level"),
        F.col("o_orderstatus").alias("flag"),
    )
    schema = make_schema({"o_orderkey": "long", "level": "double", "flag": "boolean"})
    listed = conform(raw, schema, on_error="quarantine")
    return (
        listed.select(F.inline(BAD_CELLS)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cells"))
    )


# The same rules as patterns: 2^31 splits int and long.
SQL_KIND = r"""CASE
    WHEN cell IS NULL OR lower(cell) IN ('', 'null', 'none', 'n/a', 'na') THEN 'null'
    WHEN lower(cell) IN ('true', 'false') THEN 'boolean'
    WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN 'whole'
    WHEN regexp_full_match(lower(cell), '[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)') THEN 'number'
    ELSE 'text' END"""


def _profile_sql(name: str, cell: str, source: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{k}') AS {k}_cells" for k in cells.KINDS
    )
    return f"""SELECT '{name}' AS "column", {counts}, count(*) FILTER (WHERE kind = 'whole' AND
        (TRY_CAST(cell AS HUGEINT) > 2147483647 OR TRY_CAST(cell AS HUGEINT) < -2147483648)) AS wide_cells
        FROM (SELECT cell, {SQL_KIND} AS kind FROM (SELECT {cell} AS cell FROM {source}))"""


@query(
    " UNION ALL ".join(
        [
            _profile_sql("o_orderkey", "CAST(o_orderkey AS VARCHAR)", "orders"),
            _profile_sql("o_totalprice", "CAST(o_totalprice AS VARCHAR)", "orders"),
            _profile_sql("o_orderstatus", "o_orderstatus", "orders"),
            _profile_sql(
                "padded",
                "CASE o_orderstatus WHEN 'F' THEN 'N/A' WHEN 'O' THEN 'True' ELSE CAST(o_custkey * 10000000 AS VARCHAR) END",
                "orders",
            ),
        ]
    )
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cells of each column look like; the column types follow from it."""
    status = F.col("o_orderstatus")
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        status,
        F.when(status == "F", F.lit(" N/A "))
        .when(status == "O", F.lit("True\t"))
        .otherwise((F.col("o_custkey") * 10_000_000).cast("string"))
        .alias("padded"),
    )
    return cell_profile(raw)


@query(
    f"""SELECT kind, count(*) AS cells, count(DISTINCT cell) AS different FROM (
      SELECT cell, {SQL_KIND} AS kind FROM (
        SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS cell FROM documents
        UNION ALL SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) FROM conversations))
    GROUP BY 1"""
)
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every text, read as a cell."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(
        table(spark, sf_dir, "conversations").select("text")
    )
    words = texts.select(
        F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("cell")
    )
    # Words repeat, so they are counted before they are looked at.
    counted = words.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(cells.cell_kind(F.col("cell")).alias("kind")).agg(
        F.sum("n").alias("cells"), F.count(F.lit(1)).alias("different")
    )


@query(
    """SELECT 'k' AS "column", ['int'] AS kinds FROM events HAVING count(*) > 0
    UNION ALL SELECT 'type', ['string'] UNION ALL SELECT 'at', ['string']
    UNION ALL SELECT 'user', ['int', 'long'] UNION ALL SELECT 'amount', ['double', 'int']
    UNION ALL SELECT 'inside', ['json'] UNION ALL SELECT 'flag', ['boolean', 'null']"""
)
def infer_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of every key of JSON lines built from the event log."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    low = F.col("user_id") % 2 == 0
    # The same key holds different kinds on different lines.
    user = F.when(low, F.col("user_id")).otherwise(F.col("user_id") + 10_000_000_000)
    line = F.concat(
        F.lit('{"k": '), k, F.lit(', "type": "'), F.col("event_type"), F.lit('", "at": "'),
        F.col("ts").cast("string"), F.lit('", "user": '), user, F.lit(', "amount": '),
        F.when(low, F.lit("1")).otherwise(F.lit("1.5")), F.lit(', "inside": '), F.col("props"),
        F.lit(', "flag": '), F.when(low, F.lit("true")).otherwise(F.lit("null")), F.lit("}"),
    )
    return json_profile(e.select(line.alias("value")))


@query("SELECT count(*) FILTER (WHERE l_shipdate IS NULL) AS bad_rows FROM lineitem")
def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.null_rows(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query(
    """SELECT count(*) AS bad_rows FROM (
       SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)"""
)
def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicated_values(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    """SELECT count(*) AS bad_rows FROM events
       WHERE event_type NOT IN ('signup', 'purchase', 'view', 'click')"""
)
def test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = ["signup", "purchase", "view", "click"]
    return Q.unexpected_rows(table(spark, sf_dir, "events"), "event_type", allowed)


@query(
    """SELECT count(*) AS bad_rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE l_shipdate < o_orderdate"""
)
def test_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    early = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).filter(
        F.col("l_shipdate") < F.col("o_orderdate")
    )
    return Q.offending_rows(early)


@query(
    """WITH r AS (
      SELECT 'not_null' AS test, 'o_custkey' AS "column", count(*) FILTER (WHERE o_custkey IS NULL) AS bad_rows FROM orders
      UNION ALL SELECT 'accepted_values', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
      UNION ALL SELECT 'unique', 'o_orderkey', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
      UNION ALL SELECT 'unique', 'o_custkey', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1))
      UNION ALL SELECT 'cheap orders', NULL, count(*) FILTER (WHERE o_totalprice < 2000) FROM orders)
    SELECT *, bad_rows = 0 AS passed FROM r"""
)
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tests = [
        {"type": "not_null", "column": "o_custkey"},
        {"type": "accepted_values", "column": "o_orderstatus", "values": ["O", "F"]},
        {"type": "unique", "column": "o_orderkey"},
        {"type": "unique", "column": "o_custkey"},
        {"type": "sql", "name": "cheap orders"},
    ]
    cheap = orders.filter(F.col("o_totalprice") < 2000)
    return Q.test_report(orders, tests, {"cheap orders": cheap})


@query(
    """SELECT event_id, epoch_us(ts) // 1000 AS millis, date_trunc('millisecond', ts) AS again FROM events"""
)
def epoch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", millis.alias("millis"))
    return e.withColumn("again", from_epoch(F.col("millis")).cast("timestamp_ntz"))
