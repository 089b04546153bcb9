"""Streams whose late rows are set aside and merged afterwards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import dims
from millrace.streaming import ingest, late

from .conftest import rows

BASE = dt.datetime(2026, 1, 1)
USAGE = "tenant_id string, meter string, quantity decimal(20,9), unit_cost_usd decimal(16,12), occurred_at timestamp_ntz"


def usage(spark, days):
    data = [("t", dims.COMPUTE, float(i + 1), 1.0, BASE + dt.timedelta(days=d, hours=i)) for d in days for i in range(4)]
    return spark.createDataFrame(data, "tenant_id string, meter string, quantity double, unit_cost_usd double, occurred_at timestamp_ntz").select(
        "tenant_id", "meter", F.col("quantity").cast("decimal(20,9)").alias("quantity"),
        F.col("unit_cost_usd").cast("decimal(16,12)").alias("unit_cost_usd"), "occurred_at")


ORDERS = {"in order": [[0, 1], [2, 3], [4]], "late": [[5, 6], [0, 1], [7], [6, 7, 2]], "one": [[3, 0]]}


@pytest.mark.parametrize("case", ORDERS)
def test_late_usage_is_set_aside_and_merged(spark, tmp_path, case):
    files = ORDERS[case]
    newest, wanted_late = None, 0
    for days in files:
        df = usage(spark, days)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_files(spark, f"{tmp_path}/in", df.schema)
        late.log_usage_windows(stream, f"{tmp_path}/log", f"{tmp_path}/ck", lateness="1 hour").awaitTermination()
        # a window is closed once the newest time of earlier batches is an hour past its end
        closed = [d for d in days if newest is not None and BASE + dt.timedelta(days=d + 1) <= newest - dt.timedelta(hours=1)]
        wanted_late += 4 * len(closed)
        newest = max(x for x in (newest, BASE + dt.timedelta(days=max(days), hours=3)) if x is not None)
    whole = usage(spark, [d for days in files for d in days])
    sums = late.window_sums(whole.limit(0), "1 day").schema
    assert late.late_events(spark, f"{tmp_path}/log", whole.schema).count() == wanted_late
    assert (wanted_late > 0) == (case == "late")
    assert late.marks(spark, f"{tmp_path}/log").agg(F.sum("late"), F.sum("seen")).first() == (wanted_late, whole.count())
    so_far = late.usage_so_far(spark, f"{tmp_path}/log", sums).agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    assert so_far == whole.count() - wanted_late
    out = late.reconciled(spark, f"{tmp_path}/log", whole)
    assert rows(out.drop("late_events")) == rows(late.window_sums(whole, "1 day"))
    assert out.agg(F.sum("late_events")).first()[0] == wanted_late


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    df = usage(spark, [0, 1])
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "two"):  # the second one replays the files
        stream = ingest.read_files(spark, f"{tmp_path}/in", df.schema)
        late.log_usage_windows(stream, f"{tmp_path}/log", f"{tmp_path}/{checkpoint}").awaitTermination()
    assert rows(late.reconciled(spark, f"{tmp_path}/log", df).drop("late_events")) == rows(late.window_sums(df, "1 day"))


def test_first_sightings_behind_the_watermark(spark, tmp_path):
    parts = [[(1, 10), (2, 11)], [(3, 1), (1, 10), (3, 1)], [(2, 11), (4, 12), (5, 2), (3, 1)], [(6, 30)], [(None, 0), (None, 0), (6, 30)]]
    schema = "id int, at timestamp_ntz"
    for part in parts:
        df = spark.createDataFrame([(i, BASE + dt.timedelta(days=d)) for i, d in part], schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_files(spark, f"{tmp_path}/in", df.schema)
        once = ingest.without_replays(stream, ["id"], "at", "2 days")
        ingest.log_batches(once, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
        late.log_behind(stream, "at", "2 days", f"{tmp_path}/behind", f"{tmp_path}/behind-ck").awaitTermination()
    passed = spark.read.parquet(f"{tmp_path}/log").drop("_batch")
    assert passed.where("id IN (3, 5)").isEmpty()
    found = late.first_sightings(spark, f"{tmp_path}/behind", df.schema, passed, ["id"])
    assert rows(found.select("id")) == [(3,), (5,), (None,)]
    assert rows(passed.select("id").unionByName(found.select("id"))) == [(1,), (2,), (3,), (4,), (5,), (6,), (None,)]
