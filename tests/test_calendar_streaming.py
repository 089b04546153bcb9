import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import dims
from millrace.operators import calendar as K
from millrace.schema import TableSpec, make_schema
from millrace.session import scratch_root
from millrace.sources import protocol
from millrace.streaming import ingest
from millrace.streaming.usage import activity_sessions, usage_windows

from .conftest import rows


def parsed(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "cron string")
    return {r.cron: r for r in K.parsed_schedules(df).collect()}


def test_schedule_fields(spark):
    found = parsed(
        spark, "0 2 * * *", "every 15 minutes", "every 2 hours", "Every day", "0 9-17 * * *", "0 0 * jan mon",
        "0 0 * * 7", "@hourly", "5/20 0 1,15 * ?", "0 0 1 * fri",
    )
    assert all(r.valid for r in found.values())
    assert found["0 2 * * *"].minutes == [0] and found["0 2 * * *"].hours == [2]
    assert found["every 15 minutes"].minutes == [0, 15, 30, 45]
    assert found["every 2 hours"].hours == list(range(0, 24, 2)) and found["every 2 hours"].minutes == [0]
    assert found["0 9-17 * * *"].hours == list(range(9, 18))
    assert (found["0 0 * jan mon"].months, found["0 0 * jan mon"].weekdays) == ([1], [1])
    assert found["0 0 * * 7"].weekdays == [0]
    assert found["5/20 0 1,15 * ?"].minutes == [5, 25, 45] and not found["5/20 0 1,15 * ?"].either_day
    assert found["0 0 1 * fri"].either_day and not found["0 2 * * *"].either_day


@pytest.mark.parametrize("text", ["", "* * * *", "99 * * * *", "0 0 * * xyz", "0 0 5-2 * *", "*/0 * * * *", "every 60 minutes", "1,,2 * * * *"])
def test_malformed_schedules(spark, text):
    assert not parsed(spark, text)[text].valid
    df = spark.createDataFrame([(text,)], "cron string")
    assert K.firings(df, F.lit("2026-01-01"), F.lit("2026-02-01")).count() == 0


def fired(spark, text, start, end):
    df = spark.createDataFrame([(text,)], "cron string")
    out = K.firings(df, F.lit(start), F.lit(end)).orderBy("fires_at").collect()
    return [r.fires_at for r in out]


def test_firings_are_half_open(spark):
    assert fired(spark, "0 * * * *", "2026-01-01 00:00:00", "2026-01-01 03:00:00") == [
        dt.datetime(2026, 1, 1, h) for h in range(3)
    ]
    assert fired(spark, "0 * * * *", "2026-01-01 00:00:30", "2026-01-01 01:00:01") == [dt.datetime(2026, 1, 1, 1)]
    assert fired(spark, "0 0 29 2 *", "2023-01-01", "2029-01-01") == [dt.datetime(2024, 2, 29), dt.datetime(2028, 2, 29)]
    assert fired(spark, "0 0 1 1 *", "2026-02-01", "2026-02-01") == []


def test_either_day_field_may_match(spark):
    days = [d.day for d in fired(spark, "0 0 13 * fri", "2026-03-01", "2026-04-01")]
    assert days == [6, 13, 20, 27]
    assert [d.day for d in fired(spark, "0 0 10 * fri", "2026-03-01", "2026-04-01")] == [6, 10, 13, 20, 27]


def test_due(spark):
    plans = spark.createDataFrame([("daily", "0 2 * * *"), ("new", "30 11 * * *"), ("idle", "0 2 1 1 *"), ("never", "0 3 * * *")], "name string, cron string")
    runs = spark.createDataFrame(
        [("daily", dt.datetime(2026, 3, 1, 2)), ("daily", dt.datetime(2026, 2, 1)), ("idle", dt.datetime(2026, 3, 1))],
        "name string, started_at timestamp_ntz",
    )
    out = {r.name: r for r in K.due(plans, runs, "name", F.lit("2026-03-03 12:00:00")).collect()}
    assert out["daily"].is_due and out["daily"].missed == 2 and out["daily"].due_since == dt.datetime(2026, 3, 2, 2)
    assert out["new"].is_due and not out["idle"].is_due and not out["never"].is_due


def landed(spark, folder, batches):
    """One file per batch, in order."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b={i}")
    return folder


def test_stream_upsert_and_replay(spark, lake, tmp_path):
    schema = make_schema({"id": "long", "v": "string", "seq": "int"})
    batches = [
        spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema),
        spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], schema),
    ]
    folder = landed(spark, f"{tmp_path}/in", batches)
    lake.ensure("st.t", TableSpec(schema, ("id",)))
    for checkpoint in ("one", "one", "two"):  # the last one replays everything
        stream = ingest.read_files(spark, f"{folder}/*", schema, files_per_batch=1)
        ingest.upsert_stream(stream, lake, "st.t", ["id"], ["seq"], f"{tmp_path}/{checkpoint}").awaitTermination()
        assert rows(lake.read("st.t").select("id", "v")) == [(1, "a"), (2, "d"), (3, "e")]


USAGE = "tenant_id string, meter string, quantity decimal(20,9), unit_cost_usd decimal(16,12), occurred_at timestamp_ntz"


def test_stream_windows_equal_the_batch_answer(spark, tmp_path):
    data = [("t", dims.COMPUTE, i, 1, dt.datetime(2026, 1, 1 + i // 10, i % 24)) for i in range(30)]
    df = spark.createDataFrame(data, "tenant_id string, meter string, quantity int, unit_cost_usd int, occurred_at timestamp_ntz").selectExpr(
        "tenant_id", "meter", "CAST(quantity AS decimal(20,9)) quantity", "CAST(unit_cost_usd AS decimal(16,12)) unit_cost_usd", "occurred_at")
    folder = landed(spark, f"{tmp_path}/in", [df.filter(f"quantity % 3 = {i}") for i in range(3)])
    stream = usage_windows(ingest.read_files(spark, f"{folder}/*", df.schema, files_per_batch=1), lateness="10 days")
    query = ingest.log_batches(stream, f"{tmp_path}/log", f"{tmp_path}/ck", "update")
    query.awaitTermination()
    keys = ["period_start", "tenant_id", "meter"]
    out = ingest.latest(spark, f"{tmp_path}/log", keys, stream.schema)
    wanted = df.groupBy(F.date_trunc("day", "occurred_at")).agg(F.sum("quantity"), F.count(F.lit(1)))
    assert rows(out.select("period_start", "quantity", "events")) == rows(wanted)


def test_replays_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 1))], "id int, at timestamp_ntz")
    folder = landed(spark, f"{tmp_path}/in", [df, df])
    stream = ingest.without_replays(ingest.read_files(spark, f"{folder}/*", df.schema, files_per_batch=1), ["id"], "at", "1 day")
    ingest.log_batches(stream, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/log").select("id")) == [(1,), (2,)]


def test_protocol_lines_as_a_stream(spark, tmp_path):
    text = tmp_path / "in" / "log.txt"
    text.parent.mkdir()
    text.write_text('noise\n{"type":"RECORD","record":{"stream":"s","data":{"id":"7"}}}\n{"broken":\n')
    lines = spark.readStream.text(str(text.parent))
    records = protocol.stream_records(protocol.parse_messages(lines), "s", make_schema({"id": "long"}))
    ingest.log_batches(records, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/log").select("id", "_emitted_at")) == [(7, 0)]


def test_streamed_sessions(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("w", base + dt.timedelta(seconds=s)) for s in (0, 30, 500, 100000)], "who string, at timestamp_ntz")
    folder = landed(spark, f"{tmp_path}/in", [df])
    stream = activity_sessions(ingest.read_files(spark, f"{folder}/*", df.schema), "who", "at", "60 seconds", "1 minute")
    ingest.log_batches(stream, f"{tmp_path}/log", f"{tmp_path}/ck", "append").awaitTermination()
    # The last stretch is still open.
    assert rows(spark.read.parquet(f"{tmp_path}/log").select("activities")) == [(1,), (2,)]


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_a_late_file_does_not_bring_older_records_back(spark, lake, tmp_path):
    schema = make_schema({"id": "long", "v": "string", "seq": "int"})
    batches = [
        spark.createDataFrame(data, schema)
        for data in ([(1, "new", 5), (2, "a", 1), (None, "n", 4)], [(1, "old", 2), (2, "b", 3), (None, "m", 3)], [(1, "mid", 4)])
    ]
    folder = landed(spark, f"{tmp_path}/in", batches)
    lake.ensure("late.t", TableSpec(schema, ("id",)))
    stream = ingest.read_files(spark, f"{folder}/*", schema, files_per_batch=1)
    ingest.upsert_stream(stream, lake, "late.t", ["id"], ["seq"], f"{tmp_path}/ck").awaitTermination()
    assert rows(lake.read("late.t")) == [(1, "new", 5), (2, "b", 3), (None, "n", 4)]
