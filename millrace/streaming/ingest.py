"""New files into tables as they arrive, by key, without losing or doubling rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.merge import last_wins, touched
from millrace.plans.tables import Lakehouse


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet",
    files_per_batch: int | None = None, name_filter: str | None = None,
) -> DataFrame:
    """A folder as a stream of its files."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def without_replays(df: DataFrame, keys: Sequence[str], at: str, lateness: str) -> DataFrame:
    """Drops a record seen before within ``lateness``; its state is bounded by that time."""
    timed = df if isinstance(df.schema[at].dataType, T.TimestampType) else df.withColumn(
        at, F.col(at).cast("timestamp")
    )
    return timed.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def upsert_stream(
    df: DataFrame,
    lake: Lakehouse,
    table: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Keyed writes of a stream into a table.

    Spark may hand over a batch twice after a failure; writing the same keys
    again changes nothing.  Files arrive in any order: with ``order_by`` a stored
    record that is newer than the batch's stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if order_by:
            held = touched(lake.read(table), batch, keys)
            batch = batch.unionByName(held, allowMissingColumns=True)
        lake.upsert(table, batch, keys, order_by)

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_batches(
    df: DataFrame, path: str, checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    """Every micro-batch as its own folder ``_batch=N`` of a change log.

    A replayed batch replaces its own folder, so the log never doubles; and an
    update costs the size of the batch, not of the table.  ``latest`` reads it.
    Aggregates use the ``update`` mode: a batch then holds the changed groups.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    return (
        df.writeStream.outputMode(output_mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType,
           order_by: Sequence[str] = ()) -> DataFrame:
    """The newest row per key of a change log."""
    with_batch = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    log = spark.read.schema(with_batch).option("basePath", path).parquet(path)
    return last_wins(log, keys, ["_batch", *order_by]).drop("_batch")
