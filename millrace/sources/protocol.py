"""Connector message logs: one JSON message per line.

A message has a ``type`` and a part named after it.  Real logs hold noise
between the messages; such lines are skipped, never an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.conform import conform
from millrace.operators.once import computed_once
from millrace.operators.running import running_total
from millrace.plans.sync import Stream
from millrace.sources.files import _path

# The message types.
MESSAGE_TYPES = ["RECORD", "STATE", "LOG", "SPEC", "CONNECTION_STATUS", "CATALOG", "TRACE"]


#: A message line; the parts that differ between connectors stay variants.
MESSAGE = """type STRING,
    record STRUCT<stream: STRING, namespace: STRING, emitted_at: BIGINT, data: VARIANT>,
    state STRUCT<stream: STRING, data: VARIANT>,
    log VARIANT, spec VARIANT, catalog VARIANT, trace VARIANT,
    connectionStatus VARIANT, connection_status VARIANT"""


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of log files (``value``) with their ``position``: file, block of the file, line in the block.

    Positions rise along a file, whose blocks are read by several tasks, and
    files follow each other by name.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select("value", place.alias("position"))


def parse_messages(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``type, stream, namespace, emitted_at, data, payload`` of every message line, and the columns to keep.

    Works on batch and streaming frames.  ``data`` (a variant) is the record or
    the state; ``payload`` is the part of the other types.
    """
    texts = lines.select(F.btrim(F.col(column), F.lit(" \t\r\n")).alias("text"), *keep)
    messages = texts.filter(F.col("text").startswith("{"))
    parsed = computed_once(messages, message=F.from_json("text", MESSAGE)).select("message.*", *keep)
    names = ", ".join(f"'{t}'" for t in MESSAGE_TYPES)
    # A record that names no stream belongs to nobody.
    known = parsed.filter(
        f"type IN ({names}) AND (type <> 'RECORD' OR record.stream IS NOT NULL)"
    )
    return known.selectExpr(
        "type",
        "CASE type WHEN 'RECORD' THEN record.stream WHEN 'STATE' THEN state.stream END AS stream",
        "CASE type WHEN 'RECORD' THEN record.namespace END AS namespace",
        "CASE type WHEN 'RECORD' THEN coalesce(record.emitted_at, 0) END AS emitted_at",
        "CASE type WHEN 'RECORD' THEN record.data WHEN 'STATE' THEN state.data END AS data",
        "CASE type WHEN 'CONNECTION_STATUS' THEN coalesce(connectionStatus, connection_status) "
        "WHEN 'LOG' THEN log WHEN 'SPEC' THEN spec WHEN 'CATALOG' THEN catalog "
        "WHEN 'TRACE' THEN trace END AS payload",
        *keep,
    )


def committed_states(messages: DataFrame, max_records: int | None = None) -> DataFrame:
    """``stream, state, position, records``: what each STATE of a log commits.

    ``messages`` keep their ``position``.  A state stands for the records before
    it: ``records`` counts those of its own stream, or of all streams if it names
    none.  With ``max_records`` the log ends behind that many records, so states
    further on commit nothing.  Counts run over blocks of files, then inside them.
    """
    kinds = messages.where(F.col("type").isin("RECORD", "STATE"))
    one = F.when(F.col("type") == "RECORD", 1).otherwise(0).cast("bigint")
    # A state without a stream counts every record, so all records also count for the stream of no name.
    marked = kinds.select("type", "stream", "position", F.to_json("data").alias("state"), one.alias("_one"))
    copies = marked.where("type = 'RECORD' AND stream IS NOT NULL").withColumns(
        {"stream": F.lit(None).cast("string"), "state": F.lit(None).cast("string")}
    )
    levels = [F.col("position.file"), F.struct("position.file", "position.block")]
    counted = running_total(marked.unionByName(copies), ["stream"], ["position"], "_one", "records", levels)
    states = counted.where("type = 'STATE'").select("stream", "state", "position", "records")
    if max_records is None:
        return states
    end = counted.where(F.col("stream").isNull() & (F.col("_one") == 1) & (F.col("records") == max_records))
    last = end.agg(F.min("position").alias("_end"))
    kept = F.col("_end").isNull() | (F.col("position") < F.col("_end"))
    return states.crossJoin(F.broadcast(last)).where(kept).drop("_end")


def resume_points(states: DataFrame) -> DataFrame:
    """The last committed state of every stream: ``stream, state, records``."""
    return states.groupBy("stream").agg(
        F.max_by("state", "position").alias("state"), F.max_by("records", "position").alias("records")
    )


def log_streams(
    messages: DataFrame, schemas: Mapping[str, T.StructType], keys: Mapping[str, Sequence[str]] | None = None
) -> dict[str, Stream]:
    """The streams of a message log as a source for ``sync``; ``_emitted_at`` is their cursor.

    Records that repeat after a replay are merged by key, the last emitted one wins.
    """
    keys = keys or {}
    return {
        name: Stream(
            name, lambda name=name, schema=schema: stream_records(messages, name, schema), tuple(keys.get(name, ())), "_emitted_at"
        )
        for name, schema in schemas.items()
    }


def stream_records(
    messages: DataFrame, stream: str, schema: T.StructType, on_error: str = "fail"
) -> DataFrame:
    """The records of one stream as the columns of ``schema``, with ``_emitted_at``."""
    mine = messages.filter((F.col("type") == "RECORD") & (F.col("stream") == stream))
    cells = mine.select(
        *[F.try_variant_get("data", _path(f.name), "string").alias(f.name) for f in schema.fields],
        F.col("emitted_at").alias("_emitted_at"),
    )
    wanted = T.StructType([*schema.fields, T.StructField("_emitted_at", T.LongType())])
    return conform(cells, wanted, on_error)


def last_states(messages: DataFrame, order_by: str) -> DataFrame:
    """The newest state per stream, as JSON text."""
    states = messages.filter(F.col("type") == "STATE")
    return states.groupBy("stream").agg(
        F.max_by(F.to_json("data"), F.col(order_by)).alias("state")
    )


def record_lines(df: DataFrame, stream: str, emitted_at: Column, namespace: str | None = None) -> DataFrame:
    """Rows as RECORD message lines; absent values are left out of the message."""
    record = F.struct(
        F.lit(stream).alias("stream"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("data"),
        emitted_at.cast("bigint").alias("emitted_at"),
        F.lit(namespace).cast("string").alias("namespace"),
    )
    return df.select(
        F.to_json(F.struct(F.lit("RECORD").alias("type"), record.alias("record"))).alias("value")
    )


def state_line(spark, stream: str, cursor: str) -> DataFrame:
    """One STATE message line holding a cursor."""
    state = F.struct(
        F.struct(F.struct(F.lit(cursor).alias("cursor")).alias(stream)).alias("data"),
        F.lit(stream).alias("stream"),
    )
    return spark.range(1).select(
        F.to_json(F.struct(F.lit("STATE").alias("type"), state.alias("state"))).alias("value")
    )
