"""Batches of texts that ask all other batches about their fingerprints.

A word, window or shingle as a row of its own costs more to shuffle than the
text it comes from.  Here a batch of some megabytes of text sends each bucket
of the fingerprint space one packed array of its distinct fingerprints; a
bucket merges the arrays of all batches and answers each of them with an array
in the same order.  Buckets follow the input's size, so that one bucket always
fits a task, and a fingerprint that fills a third of all texts is still one
entry in each batch's array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.text import Texts
from millrace.session import scratch_path

#: Bytes of text in a batch; a longer text is a batch of its own.
PACK_BYTES = 3 << 20
#: Entries that one bucket is laid out for.
BUCKET_KEYS = 1 << 20
LEAST_BUCKETS = 64

#: Bytes that an executor and its Python workers hand each other at once; Spark's own limit is 64 MB,
#: which each task has outside the heap, and twice while it grows, and its worker once more.
ARROW_KEY, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

BATCH_SCHEMA = "batch long, ids binary, ends binary, data binary, extra binary"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand their Python workers ``ARROW_BYTES`` at once, or one row, if the session has no lower limit."""
    before = spark.conf.get(ARROW_KEY, None)
    if before is not None and 0 < _bytes(before) <= _bytes(ARROW_BYTES):
        yield
        return
    spark.conf.set(ARROW_KEY, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(ARROW_KEY) if before is None else spark.conf.set(ARROW_KEY, before)


def _bytes(text: str) -> int:
    number = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


def in_small_batches(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function of a frame with all jobs it runs itself in ``small_batches``."""

    @wraps(function)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with small_batches(docs.sparkSession):
            return function(docs, *args, **kwargs)

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a schema string; for the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of jobs that nothing refers to any more.

    They would go at the driver's next full collection, which may be half an
    hour away.  Where the driver's JVM can't be reached there is nothing to do.
    """
    import gc

    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    for _ in range(2):  # the second takes what the first one's finalizers let go
        gc.collect()
        if jvm is not None:
            jvm.System.gc()


@dataclass
class Batch:
    """One stored batch."""

    number: int
    texts: Texts
    extra: bytes


def unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[Batch]:
    for i in range(table.num_rows):
        row = {n: table.column(n)[i] for n in ("batch", "ids", "ends", "data", "extra")}
        texts = Texts(
            np.frombuffer(row["data"].as_buffer(), np.uint8),
            np.frombuffer(row["ends"].as_buffer(), np.int64),
            np.frombuffer(row["ids"].as_buffer(), np.int64),
        )
        yield Batch(row["batch"].as_py(), texts, row["extra"].as_py())


def packed(number: int, texts: Texts, extra: bytes = b"") -> dict:
    return {
        "batch": number,
        "ids": np.ascontiguousarray(texts.ids, np.int64).tobytes(),
        "ends": np.ascontiguousarray(texts.ends, np.int64).tobytes(),
        "data": texts.data.tobytes(),
        "extra": extra,
    }


BATCH_ARROW = pa.schema(
    [("batch", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("extra", pa.binary())]
)


def pack(docs: DataFrame, name: str, limit: int = PACK_BYTES, mark: str | None = None) -> DataFrame:
    """Texts (``doc_id``, ``text``) as stored batches; ``extra`` holds the long column ``mark`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        data: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        marks: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            texts = Texts(np.concatenate(data), ends, np.concatenate(ids))
            return pa.RecordBatch.from_pylist([packed(number, texts, b"".join(marks))], schema=BATCH_ARROW)

        for batch in batches:
            whole = Texts.of(batch.column("text"), batch.column("doc_id"))
            marked = None if mark is None else batch.column(mark).to_numpy()
            start = 0
            while start < len(whole):
                room = max(limit - held, 0)
                stop = int(np.searchsorted(whole.ends, whole.ends[start] + room, "right")) - 1
                if stop <= start and held:
                    yield flush()
                    data, ids, sizes, marks, held, number = [], [], [], [], 0, number + 1
                    continue
                stop = min(max(stop, start + 1), len(whole))
                data.append(whole.data[whole.ends[start] : whole.ends[stop]].copy())
                ids.append(whole.ids[start:stop])
                sizes.append(np.diff(whole.ends[start : stop + 1]))
                if marked is not None:
                    marks.append(marked[start:stop].tobytes())
                held += len(data[-1])
                start = stop
        if ids:
            yield flush()

    columns = ["doc_id", "text"] if mark is None else ["doc_id", "text", mark]
    return stored(docs.select(*columns).mapInArrow(run, BATCH_SCHEMA), name)


def total_bytes(batches: DataFrame) -> int:
    return batches.agg(F.sum(F.octet_length("data"))).first()[0] or 0


def bucket_bits(entries: float) -> int:
    """Bits of the fingerprint that say its bucket."""
    return max(LEAST_BUCKETS - 1, int(entries / BUCKET_KEYS)).bit_length()


def send(
    batches: DataFrame, emit: Callable[[Batch], tuple[np.ndarray, np.ndarray]], bits: int, width: int
) -> DataFrame:
    """Rows (bucket, batch, keys, values): each batch's distinct fingerprints by bucket.

    ``emit`` gives sorted distinct 64-bit fingerprints and a number for each.
    ``width`` bytes after the bucket's bits are kept of a fingerprint.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in unpacked(part):
                keys, values = emit(batch)
                cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                cuts = np.append(cuts, len(keys))
                short = squeeze(keys, bits, width)
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full.astype(np.int32)),
                            pa.array(np.full(len(full), batch.number, np.int64)),
                            pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                            pa.array([values[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                        ],
                        names=["bucket", "batch", "keys", "vals"],
                    )

    return batches.mapInArrow(run, "bucket int, batch long, keys binary, vals binary")


def squeeze(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The ``width`` bytes of each key that follow its first ``bits`` bits, as rows of bytes."""
    return (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]


def widen(blob: pa.Buffer, width: int) -> np.ndarray:
    short = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :width] = short
    return out.view(">u8").astype(np.uint64).ravel()


def answer(
    sent: DataFrame, bits: int, width: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: type
) -> DataFrame:
    """Rows (batch, bucket, reply): what ``merge`` says of each key, in the order sent.

    ``merge(keys, values)`` gets all entries of a bucket, in the order of the
    batches, and gives one reply for each.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch").combine_chunks()
        blobs = [widen(x.as_buffer(), width) for x in table.column("keys")]
        values = np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in table.column("vals")])
        reply = merge(np.concatenate(blobs), values)
        ends = np.cumsum([len(x) for x in blobs])[:-1]
        out = [x.tobytes() for x in np.split(reply, ends)]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "reply": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "batch long, bucket int, reply binary")


def replies(right: pa.Table, dtype: type) -> np.ndarray:
    """A batch's replies in the order of its sorted fingerprints."""
    if not right.num_rows:
        return np.zeros(0, dtype)
    right = right.combine_chunks()
    order = np.argsort(right.column("bucket").to_numpy())
    column = right.column("reply")
    return np.concatenate([np.frombuffer(column[int(i)].as_buffer(), dtype) for i in order])


def apply(batches: DataFrame, answers: DataFrame, function: Callable[[Batch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` of each batch and its replies; the batches are shuffled once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [function(b, right) for b in unpacked(left)]
        return pa.concat_tables(made)

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
