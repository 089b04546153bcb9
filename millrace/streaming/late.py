"""Streams that lose no row to the watermark: late ones are set aside, counted and merged later.

A stateful stream forgets closed windows and old keys, and drops what comes
after that without a word.  Here the rows behind the watermark go to a side log,
and a batch job merges them into what the stream has written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.merge import last_wins
from millrace.usage import money
from millrace.usage.summary import cost

WINDOW_KEYS = ("period_start", "tenant_id", "meter")
_MARK = "newest timestamp, late bigint, seen bigint"


def _part(path: str, kind: str, batch_id: int) -> str:
    return f"{path}/{kind}/_batch={batch_id}"


def _log(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """A log of micro-batches; empty while nothing was written to it."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{kind}/_batch=-1")
    with_batch = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(with_batch).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")


def marks(spark: SparkSession, path: str) -> DataFrame:
    """What every micro-batch saw: the newest time so far, its rows and the late ones among them."""
    return _log(spark, path, "marks", T.StructType.fromDDL(_MARK)).where("_batch >= 0")


def _watermark(spark: SparkSession, path: str, batch_id: int, lateness: str) -> Column:
    """The newest time that earlier batches have seen, less the lateness; NULL before the first one.

    Every mark holds the newest time up to its batch, so one row is read.
    """
    before = marks(spark, path).where(F.col("_batch") == batch_id - 1).first() if batch_id > 0 else None
    newest = before["newest"] if before is not None else None
    return F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")


def _mark(spark: SparkSession, path: str, batch_id: int, newest: object, late: int, seen: int) -> None:
    row = spark.createDataFrame([(newest, late, seen)], _MARK)
    row.coalesce(1).write.mode("overwrite").parquet(_part(path, "marks", batch_id))


def window_sums(events: DataFrame, width: str) -> DataFrame:
    """Quantity, cost and number of events per tenant, meter and window."""
    timed = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return (
        timed.groupBy(F.window("occurred_at", width).alias("w"), "tenant_id", "meter")
        .agg(
            F.sum("quantity").cast(money.QUANTITY).alias("quantity"),
            F.sum(cost()).cast(money.AMOUNT).alias("infra_cost_usd"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(F.col("w.start").alias("period_start"), "tenant_id", "meter", "quantity", "infra_cost_usd", "events")
    )


def log_usage_windows(
    events: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str = "1 hour"
) -> StreamingQuery:
    """Every micro-batch's own sums per window, and the events whose window had closed by then.

    Sums of batches add up, so nothing is held between batches but the newest
    time seen.  A window is closed once that is ``lateness`` past its end.  The
    folder of a batch is replaced when the batch comes again, so the logs
    ``sums``, ``late`` and ``marks`` under ``path`` never double.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col("occurred_at").cast("timestamp")
        closed = F.coalesce(F.window(at, width)["end"] <= _watermark(spark, path, batch_id, lateness), F.lit(False))
        found = batch.agg(
            F.max(at).alias("newest"), F.count_if(closed).alias("late"), F.count(F.lit(1)).alias("seen")
        ).first()
        marked = batch.withColumn("_late", closed)
        window_sums(marked.where(~F.col("_late")).drop("_late"), width).write.mode("overwrite").parquet(
            _part(path, "sums", batch_id)
        )
        late = marked.where("_late").drop("_late")
        if not found["late"]:  # nothing to read for, but the folder of an earlier try must not stay
            late = late.limit(0)
        late.write.mode("overwrite").parquet(_part(path, "late", batch_id))
        before = marks(spark, path).where(F.col("_batch") == batch_id - 1).first() if batch_id > 0 else None
        times = [t for t in (found["newest"], before and before["newest"]) if t is not None]
        _mark(spark, path, batch_id, max(times, default=None), found["late"], found["seen"])

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def usage_so_far(spark: SparkSession, path: str, sums: T.StructType) -> DataFrame:
    """The windows as the stream has them, late events left out."""
    log = _log(spark, path, "sums", sums)
    return log.groupBy(*WINDOW_KEYS).agg(
        F.sum("quantity").cast(money.QUANTITY).alias("quantity"),
        F.sum("infra_cost_usd").cast(money.AMOUNT).alias("infra_cost_usd"),
        F.sum("events").alias("events"),
    )


def late_events(spark: SparkSession, path: str, events: T.StructType) -> DataFrame:
    """The events that came after their window had closed, with the batch that brought them."""
    return _log(spark, path, "late", events)


def reconciled(spark: SparkSession, path: str, events: DataFrame, width: str = "1 day") -> DataFrame:
    """The windows with their late events, and how many these are: ``late_events``.

    ``events`` gives the schema.  The result is what a batch job over all events
    would say, however they arrived.
    """
    empty = spark.createDataFrame([], events.schema)
    sums = window_sums(empty, width).schema
    on_time = usage_so_far(spark, path, sums).withColumn("late_events", F.lit(0).cast("bigint"))
    late = window_sums(late_events(spark, path, events.schema).drop("_batch"), width)
    both = on_time.unionByName(late.withColumn("late_events", F.col("events")))
    return both.groupBy(*WINDOW_KEYS).agg(
        F.sum("quantity").cast(money.QUANTITY).alias("quantity"),
        F.sum("infra_cost_usd").cast(money.AMOUNT).alias("infra_cost_usd"),
        F.sum("events").alias("events"),
        F.sum("late_events").alias("late_events"),
    )


def log_behind(df: DataFrame, at: str, lateness: str, path: str, checkpoint: str) -> StreamingQuery:
    """Rows that another stateful stream over the same files may drop as late.

    A row is logged if it is older than the newest row of its own or an earlier
    micro-batch, less the lateness.  That takes in every row the other stream
    drops, wherever its batches end; ``first_sightings`` leaves out the ones
    that it did let through.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        time = F.col(at).cast("timestamp")
        facts = batch.agg(F.max(time).alias("newest"), F.count(F.lit(1)).alias("seen")).first()
        before = marks(spark, path).where(F.col("_batch") == batch_id - 1).first() if batch_id > 0 else None
        times = [t for t in (facts["newest"], before and before["newest"]) if t is not None]
        newest = max(times, default=None)
        bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = batch.where(time <= bound)
        late.write.mode("overwrite").parquet(_part(path, "late", batch_id))
        written = spark.read.schema(batch.schema).parquet(_part(path, "late", batch_id)).count()
        _mark(spark, path, batch_id, newest, written, facts["seen"])

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_sightings(
    spark: SparkSession, path: str, schema: T.StructType, passed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The late rows whose key the stream never let through, one per key, with its columns.

    Both sides are reduced to one row per key before they meet.
    """
    late = last_wins(late_events(spark, path, schema).drop("_batch"), keys, [])
    known = passed.select(*[F.col(f"`{k}`").alias(f"_passed_{k}") for k in keys]).distinct()
    same = F.expr(" AND ".join(f"`{k}` <=> `_passed_{k}`" for k in keys))
    return late.join(known, same, "left_anti")
