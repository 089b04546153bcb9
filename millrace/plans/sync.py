"""Syncs: source streams into tables, with checkpoints, one result row per stream."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.functions.identifiers import slug
from millrace.operators.merge import cursor_text, since
from millrace.plans.tables import Lakehouse, Written
from millrace.schema import TableSpec

FULL, INCREMENTAL = "full_refresh", "incremental"
APPEND, OVERWRITE, MERGE = "append", "overwrite", "merge"


class SyncError(ValueError):
    """A sync that cannot be set up, with the reason."""


@dataclass(frozen=True)
class Stream:
    """One named table of a source."""

    name: str
    #: Gives the rows; called again for every sync.
    read: Callable[[], DataFrame]
    keys: tuple[str, ...] = ()
    cursor: str | None = None
    #: Declared types win over the ones found in the data.
    schema: T.StructType | None = None

    @property
    def incremental(self) -> bool:
        return self.cursor is not None


Source = Mapping[str, Stream]


@dataclass(frozen=True)
class SyncSpec:
    """A stream and how to sync it; what is left out comes from the stream."""

    stream: str
    sync_mode: str = FULL
    write_mode: str | None = None
    cursor: str | None = None
    keys: tuple[str, ...] = ()
    table: str | None = None
    max_records: int | None = None
    inclusive: bool = True
    on_error: str = "fail"
    #: An incremental read in so many ranges of the cursor, each written and committed on its own.
    ranges: int = 1
    #: Stop after so many ranges; the next sync goes on behind them.
    max_ranges: int | None = None

    def resolved(self, source: Source) -> SyncSpec:
        """All choices made.

        A stream that has no cursor is fully refreshed.  Incremental streams are
        merged and full ones overwritten unless said otherwise; a merge without
        a key can only append.
        """
        stream = source.get(self.stream)
        if stream is None:
            raise SyncError(f"no stream {self.stream}; there are {sorted(source)}")
        if self.sync_mode not in (FULL, INCREMENTAL):
            raise SyncError(f"unknown sync mode: {self.sync_mode}")
        cursor = self.cursor or stream.cursor
        mode = self.sync_mode if cursor or self.sync_mode == FULL else FULL
        keys = self.keys or stream.keys
        write = self.write_mode or (MERGE if mode == INCREMENTAL else OVERWRITE)
        if write not in (APPEND, OVERWRITE, MERGE):
            raise SyncError(f"unknown write mode: {write}")
        if write == MERGE and not keys:
            write = APPEND
        if self.max_records is not None and not self.inclusive:
            raise SyncError("a cap may cut between equal cursors, so it needs inclusive reads")
        if self.ranges < 1 or (self.max_ranges is not None and self.max_ranges < 1):
            raise SyncError("a sync has at least one range")
        if self.ranges > 1 and (mode != INCREMENTAL or self.max_records is not None):
            raise SyncError("ranges are for incremental syncs without a cap")
        return replace(
            self,
            sync_mode=mode,
            write_mode=write,
            cursor=cursor,
            keys=tuple(keys),
            table=self.table or self.stream,
        )


# ------------------------------------------------------------------ checkpoints

CHECKPOINT_SCHEMA = (
    "source string, stream string, cursor_column string, cursor_type string, "
    "cursor_value string, run_id string, committed_at timestamp"
)
LOG_SCHEMA = (
    "run_id string, source string, stream string, table_name string, records bigint, "
    "bytes_moved bigint, schema_changed boolean, succeeded boolean, error string, "
    "seconds double, records_per_second double, finished_at timestamp"
)


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The last committed checkpoint of every stream."""
    value = F.struct("cursor_column", "cursor_type", "cursor_value", "run_id")
    newest = F.max_by(value, F.struct("committed_at", "run_id")).alias("c")
    return checkpoints.groupBy("source", "stream").agg(
        newest, F.max("committed_at").alias("committed_at")
    ).select("source", "stream", "c.*", "committed_at")


@dataclass
class SyncState:
    """Checkpoints and results as tables of the lakehouse."""

    lake: Lakehouse
    namespace: str = "ops"
    tables: dict[str, str] = field(default_factory=dict)

    def _append(self, name: str, ddl: str, row: tuple) -> None:
        spark = self.lake.spark
        frame = spark.createDataFrame([row], ddl)
        table = f"{self.namespace}.{name}"
        self.lake.ensure(table, TableSpec(frame.schema))
        self.lake.append(table, frame)

    def cursor(self, source: str, stream: str, column: str) -> object | None:
        """The last committed cursor as a literal of its own type; none means a full read."""
        table = f"{self.namespace}.checkpoints"
        if not self.lake.exists(table):
            return None
        mine = self.lake.read(table).filter(
            (F.col("source") == source)
            & (F.col("stream") == stream)
            & (F.col("cursor_column") == column)
        )
        row = latest_checkpoints(mine).first()
        if row is None or row["cursor_value"] is None:
            return None
        return F.lit(row["cursor_value"]).cast(row["cursor_type"])

    def commit(self, source: str, stream: str, column: str, kind: str, value: str, run: str) -> None:
        """``value`` as text, made by the job that read the rows: the driver's zone plays no part."""
        now = datetime.now(timezone.utc)
        self._append("checkpoints", CHECKPOINT_SCHEMA, (source, stream, column, kind, value, run, now))

    def log(self, row: tuple) -> None:
        self._append("sync_log", LOG_SCHEMA, row)


# ------------------------------------------------------------------------ syncs


def capped_since(df: DataFrame, cursor: str, last: object | None, limit: int) -> DataFrame:
    """About ``limit`` new rows in cursor order, with all ties of the last one.

    Only rows beyond the checkpoint count, and the replayed boundary comes on
    top, so every capped read moves on, however many rows share a cursor.  Rows
    without a cursor come with the first read, since no later one would see them.
    """
    column = F.col(f"`{cursor}`")
    kind = df.schema[cursor].dataType
    fresh = since(df, cursor, last, inclusive=False).filter(column.isNotNull()).select(column.alias("c"))
    end = fresh.orderBy("c").limit(limit).agg(
        F.count(F.lit(1)).alias("n"), cursor_text(F.max("c"), kind).alias("c")
    ).first()
    df = since(df, cursor, last)
    if end["n"] < limit:
        return df
    upto = column <= F.lit(end["c"]).cast(kind)
    return df.filter(upto | column.isNull() if last is None else upto)


def _capped(lake: Lakehouse, df: DataFrame, spec: SyncSpec, table: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, the first ones by key, which never take the place of a table that has rows."""
    if spec.write_mode == OVERWRITE and lake.exists(table) and not lake.read(table).isEmpty():
        if not df.offset(limit).isEmpty():
            raise SyncError(f"{spec.stream} has more than {limit} rows; a part of them can't replace {table}")
    return (df.orderBy(*[F.col(f"`{k}`") for k in spec.keys]) if spec.keys else df).limit(limit)


#: Cursor types whose quantiles Spark can estimate.
_CUT_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def cursor_ranges(df: DataFrame, cursor: str, last: object | None, ranges: int) -> list[object]:
    """Up to ``ranges`` rising upper ends of the cursor, as literals, that cut the new rows evenly.

    One aggregate over the cursor column; the driver gets one value per range.
    All rows with one cursor are in one range.  A cursor without quantiles, such
    as text, is one range, and the list is empty if nothing is new.
    """
    kind = df.schema[cursor].dataType
    column = F.col(f"`{cursor}`")
    fresh = since(df, cursor, last, inclusive=False).where(column.isNotNull())
    if ranges > 1 and isinstance(kind, _CUT_TYPES):
        marks = F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10_000)
    else:
        marks = F.array().cast(T.ArrayType(kind))
    ends = F.array_sort(F.array_distinct(F.concat(marks.cast(T.ArrayType(kind)), F.array(F.max(column)))))
    found = fresh.agg(F.transform(F.filter(ends, lambda e: e.isNotNull()), lambda e: cursor_text(e, kind)).alias("ends"))
    return [F.lit(text).cast(kind) for text in found.first()["ends"]]


def range_pieces(df: DataFrame, cursor: str, last: object | None, inclusive: bool, ends: Sequence[object]):
    """The new rows as one frame for each end, in cursor order.

    The first one replays the boundary if reads are inclusive and, on a first
    sync, takes the rows without a cursor.
    """
    column = F.col(f"`{cursor}`")
    for i, end in enumerate(ends):
        if i == 0:
            piece = since(df, cursor, last, inclusive).where(column <= end)
            yield piece.unionByName(df.where(column.isNull())) if last is None else piece
        else:
            yield df.where((column > ends[i - 1]) & (column <= end))


def sync_ranges(
    lake: Lakehouse, stream: Stream, spec: SyncSpec, table: str, last: object | None, commit: Callable[[Written], None]
) -> Written:
    """An incremental sync range by range; ``commit`` is called after each, so a restart goes on behind the last one.

    Each range is read with its bounds pushed to the source.
    """
    df = stream.read()
    ends = cursor_ranges(df, spec.cursor, last, spec.ranges)
    total = Written(table, 0, 0)
    pieces = range_pieces(df, spec.cursor, last, spec.inclusive, ends)
    if not ends:  # nothing new but the boundary, and rows without a cursor
        pieces = iter([since(df, spec.cursor, last, spec.inclusive)])
    for number, piece in enumerate(pieces):
        if spec.max_ranges is not None and number >= spec.max_ranges:
            break
        one = sync_stream(lake, replace(stream, read=lambda piece=piece: piece), replace(spec, ranges=1), table, None)
        commit(one)
        total = Written(
            table, total.rows + one.rows, total.bytes_moved + one.bytes_moved,
            total.schema_changed or one.schema_changed, one.cursor, total.rejected + one.rejected,
        )
    return total


def sync_stream(
    lake: Lakehouse, stream: Stream, spec: SyncSpec, table: str, last: object | None,
    limit: int | None = None,
) -> Written:
    """Read, evolve the table, write.  Nothing is committed here."""
    df = stream.read()
    if spec.sync_mode == INCREMENTAL:
        if limit is None:
            df = since(df, spec.cursor, last, spec.inclusive)
        else:
            df = capped_since(df, spec.cursor, last, limit)
    elif limit is not None:
        df = _capped(lake, df, spec, table, limit)
    observed = S.flat(df.schema)
    wanted = S.reconcile(stream.schema, observed)
    changed = lake.ensure(table, TableSpec(wanted, keys=spec.keys))
    watch = spec.cursor if spec.sync_mode == INCREMENTAL else None
    common = {"on_error": spec.on_error, "cursor": watch, "schema_changed": changed}
    if spec.write_mode == OVERWRITE:
        return lake.overwrite(table, df, **common)
    if spec.write_mode == MERGE:
        newest = [spec.cursor] if spec.cursor else []
        return lake.upsert(table, df, spec.keys, newest, **common)
    return lake.append(table, df, **common)


def sync(
    spark: SparkSession,
    name: str,
    source: Source,
    specs: Sequence[SyncSpec],
    namespace: str = "raw",
    lake: Lakehouse | None = None,
    max_records: int | None = None,
    run_id: str | None = None,
    state_namespace: str = "ops",
) -> DataFrame:
    """Sync streams of one source; returns the log rows of this run.

    The checkpoint of a stream is written after its rows are, so a crash in
    between replays rows and never skips any; the keyed write makes the replay
    harmless.  A stream that fails leaves the others alone.  Streams that come
    after ``max_records`` are used up are left as they are, without a log row.
    Two streams may not share a table.
    """
    lake = lake or Lakehouse(spark)
    state = SyncState(lake, state_namespace)
    run = run_id or uuid.uuid4().hex
    chosen = [s.resolved(source) for s in specs]
    homes = Counter(slug(s.table) for s in chosen)
    shared = sorted(n for n, k in homes.items() if k > 1)
    if shared:
        raise SyncError(f"several streams would write the tables {shared}")
    left = max_records
    rows = []
    for spec in chosen:
        if left == 0:
            break
        stream = source[spec.stream]
        table = f"{namespace}.{slug(spec.table)}"
        started = time.monotonic()
        written, error = None, None
        limit = min((n for n in (spec.max_records, left) if n is not None), default=None)
        try:
            last = None
            if spec.sync_mode == INCREMENTAL:
                last = state.cursor(name, spec.stream, spec.cursor)

            def commit(part: Written, spec: SyncSpec = spec, table: str = table) -> None:
                if part.cursor is not None:
                    kind = lake.spec(table).schema[spec.cursor].dataType.simpleString()
                    state.commit(name, spec.stream, spec.cursor, kind, part.cursor, run)

            if spec.ranges > 1 and limit is None:
                written = sync_ranges(lake, stream, spec, table, last, commit)
            else:
                written = sync_stream(lake, stream, spec, table, last, limit)
                commit(written)
        except Exception as problem:  # noqa: BLE001 - reported in the stream's own row
            error = f"{type(problem).__name__}: {problem}"[:2000]
        seconds = time.monotonic() - started
        records = written.rows if written else 0
        if left is not None:
            left = max(0, left - records)
        row = (
            run, name, spec.stream, table, records, written.bytes_moved if written else 0,
            bool(written and written.schema_changed), error is None, error, seconds,
            records / seconds if seconds > 0 else 0.0, datetime.now(timezone.utc),
        )
        state.log(row)
        rows.append(row)
    return spark.createDataFrame(rows, LOG_SCHEMA)


def records_per_run(sync_log: DataFrame) -> DataFrame:
    """One row per run: records, bytes, and whether every stream succeeded."""
    return sync_log.groupBy("run_id").agg(
        F.sum("records").alias("records"),
        F.sum("bytes_moved").alias("bytes_moved"),
        F.bool_and("succeeded").alias("succeeded"),
    )


def run_rollup(task_log: DataFrame) -> DataFrame:
    """One row per run from its tasks: ``run_id, kind, status, records``.

    A run failed when any of its tasks did.
    """
    failed, ok = F.col("status") == "failed", F.col("status") == "succeeded"
    synced = F.when(F.col("kind") == "ingest", F.col("records"))
    return task_log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.sum(synced), F.lit(0)).alias("records_synced"),
        F.count_if((F.col("kind") == "transform") & ok).alias("models_built"),
        F.when(F.bool_or(failed), F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
    )


def json_bytes(df: DataFrame) -> DataFrame:
    """Rows and the size of the rows written as JSON, the measure of what a sync moved."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("json_bytes")
    )
