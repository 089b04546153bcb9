import time

from pyspark.sql import functions as F

import pytest

from millrace import schema as S
from millrace.plans import sync as Y
from millrace.plans.lakehouse_run import run_lakehouse
from millrace.plans.models import EPHEMERAL, VIEW, Model
from millrace.sources import sample

from .conftest import rows


def retail(spark, count=50):
    return {
        "customers": Y.Stream("customers", lambda: sample.customers(spark), keys=("customer_id",)),
        "orders": Y.Stream("orders", lambda: sample.orders(spark, count), ("order_id",), "ordered_at"),
    }


INCREMENTAL = Y.SyncSpec("orders", Y.INCREMENTAL)


def logged(df):
    return {r.stream: r for r in df.collect()}


def test_choices_are_filled_in():
    source = {
        "a": Y.Stream("a", None, ("id",), "at"),
        "b": Y.Stream("b", None),
    }
    full = Y.SyncSpec("a").resolved(source)
    assert (full.sync_mode, full.write_mode, full.table) == (Y.FULL, Y.OVERWRITE, "a")
    news = Y.SyncSpec("a", Y.INCREMENTAL).resolved(source)
    assert (news.write_mode, news.cursor, news.keys) == (Y.MERGE, "at", ("id",))
    assert Y.SyncSpec("b", Y.INCREMENTAL).resolved(source).sync_mode == Y.FULL
    assert Y.SyncSpec("b", write_mode=Y.MERGE).resolved(source).write_mode == Y.APPEND
    assert Y.SyncSpec("a", write_mode=Y.APPEND).resolved(source).write_mode == Y.APPEND
    with pytest.raises(Y.SyncError, match="there are"):
        Y.SyncSpec("zzz").resolved(source)
    with pytest.raises(Y.SyncError):
        Y.SyncSpec("a", max_records=5, inclusive=False).resolved(source)


def test_full_sync_and_repeat(spark, lake):
    specs = [Y.SyncSpec("customers"), Y.SyncSpec("orders")]
    log = logged(Y.sync(spark, "shop", retail(spark), specs, "raw1", lake))
    assert log["customers"].records + log["orders"].records == 55
    assert log["orders"].succeeded and log["orders"].bytes_moved > 0 and log["orders"].schema_changed
    again = logged(Y.sync(spark, "shop", retail(spark, 30), specs, "raw1", lake))
    assert lake.read("raw1.orders").count() == 30 and not again["orders"].schema_changed


def test_incremental_sync_moves_less_and_stays_whole(spark, lake):
    first = logged(Y.sync(spark, "shop", retail(spark, 100), [INCREMENTAL], "raw2", lake))
    second = logged(Y.sync(spark, "shop", retail(spark, 100), [INCREMENTAL], "raw2", lake))
    third = logged(Y.sync(spark, "shop", retail(spark, 100), [INCREMENTAL], "raw2", lake))
    assert first["orders"].records == 100
    assert 1 <= second["orders"].records < 100 and third["orders"].records == second["orders"].records
    assert rows(lake.read("raw2.orders")) == rows(sample.orders(spark, 100))
    stored = Y.latest_checkpoints(lake.read("ops.checkpoints")).collect()
    assert [(r.source, r.stream, r.cursor_column, r.cursor_type) for r in stored] == [
        ("shop", "orders", "ordered_at", "timestamp")
    ]


def test_exclusive_reads_move_nothing_new(spark, lake):
    spec = Y.SyncSpec("orders", Y.INCREMENTAL, inclusive=False)
    Y.sync(spark, "shop", retail(spark), [spec], "raw3", lake)
    assert logged(Y.sync(spark, "shop", retail(spark), [spec], "raw3", lake))["orders"].records == 0
    assert lake.read("raw3.orders").count() == 50


def test_capped_syncs_reach_the_end(spark, lake):
    spec = Y.SyncSpec("orders", Y.INCREMENTAL, max_records=30)
    counts = []
    for _ in range(3):
        Y.sync(spark, "shop", retail(spark, 60), [spec], "raw4", lake)
        counts.append(lake.read("raw4.orders").count())
    assert counts[0] == 30 and counts == sorted(counts) and counts[2] == 60
    run = Y.sync(spark, "shop", retail(spark, 60), [Y.SyncSpec("customers"), Y.SyncSpec("orders")], "raw5", lake, max_records=8)
    assert [r.records for r in run.collect()] == [5, 3]


def test_a_failing_stream_leaves_the_others_and_no_checkpoint(spark, lake):
    def broken():
        return spark.range(3).select(
            "id", F.raise_error(F.lit("no luck")).cast("string").alias("x"), F.col("id").alias("at")
        )

    source = retail(spark) | {"broken": Y.Stream("broken", broken, ("id",), "at")}
    specs = [Y.SyncSpec("broken", Y.INCREMENTAL), Y.SyncSpec("customers")]
    log = logged(Y.sync(spark, "shop", source, specs, "raw6", lake))
    assert not log["broken"].succeeded and "no luck" in log["broken"].error
    assert log["customers"].succeeded and lake.read("raw6.customers").count() == 5
    assert not lake.exists("ops.checkpoints")
    summary = Y.records_per_run(lake.read("ops.sync_log")).collect()[0]
    assert summary.records == 5 and not summary.succeeded


def test_new_and_missing_columns(spark, lake):
    versions = iter(
        [
            spark.createDataFrame([(1, "a")], "id bigint, name string"),
            spark.createDataFrame([(2, 5)], "id bigint, extra int"),
        ]
    )
    source = {"t": Y.Stream("t", lambda: next(versions), schema=S.make_schema({"id": "long", "name": "string"}))}
    spec = [Y.SyncSpec("t", write_mode=Y.APPEND, table="My Table!")]
    Y.sync(spark, "s", source, spec, "raw7", lake)
    second = logged(Y.sync(spark, "s", source, spec, "raw7", lake))
    assert second["t"].schema_changed and second["t"].table_name == "raw7.my_table"
    assert rows(lake.read("raw7.my_table")) == [(1, "a", None), (2, None, 5)]


def test_declared_types_win(spark, lake):
    source = {"t": Y.Stream("t", lambda: spark.createDataFrame([("7",)], "id string"), schema=S.make_schema({"id": "long"}))}
    Y.sync(spark, "s", source, [Y.SyncSpec("t")], "raw8", lake)
    assert lake.read("raw8.t").dtypes == [("id", "bigint")]


def shop_models(space):
    return [
        Model("facts", f"SELECT o.*, c.country, CAST(ordered_at AS DATE) AS order_date "
              f"FROM {{{{ source('{space}', 'orders') }}}} o LEFT JOIN {{{{ source('{space}', 'customers') }}}} c "
              "ON o.customer_id = c.customer_id", namespace="mart",
              tests=({"type": "not_null", "column": "order_id"}, {"type": "unique", "column": "order_id"})),
        Model("daily", "SELECT order_date, country, count(*) AS orders, round(sum(amount), 2) AS revenue "
              "FROM {{ ref('facts') }} GROUP BY 1, 2", namespace="mart"),
        Model("mix", "SELECT category, round(100.0 * sum(amount) / sum(sum(amount)) OVER (), 1) AS pct "
              "FROM {{ ref('facts') }} GROUP BY 1", VIEW, namespace="mart"),
    ]


def test_whole_run(spark, lake):
    sources = {"shop": (retail(spark, 2000), [Y.SyncSpec("customers"), INCREMENTAL])}
    log = run_lakehouse(spark, sources, shop_models("raw9"), lake, "raw9", compact_below=128_000_000)
    summary = Y.run_rollup(log).collect()[0]
    assert (summary.records_synced, summary.models_built, summary.status) == (2005, 3, "succeeded")
    assert lake.read("mart.facts").count() == 2000
    total = spark.table("mart.mix").agg(F.round(F.sum("pct"), 0)).first()[0]
    assert total == 100
    only = run_lakehouse(spark, sources, shop_models("raw9"), lake, "raw9", skip_ingest=True, select=["daily"])
    assert [r.task for r in only.collect()] == ["facts", "daily"]


def test_models_of_a_failed_sync_are_skipped(spark, lake):
    bad = {"orders": Y.Stream("orders", lambda: spark.table("nowhere.at_all"))}
    sources = {"shop": (retail(spark) | bad, [Y.SyncSpec("customers"), Y.SyncSpec("orders")])}
    log = {r.task: r.status for r in run_lakehouse(spark, sources, shop_models("raw10"), lake, "raw10").collect()}
    assert log == {
        "shop.customers": "succeeded", "shop.orders": "failed",
        "facts": "skipped", "daily": "skipped", "mix": "skipped",
    }
    assert EPHEMERAL


def test_a_cap_smaller_than_the_ties_of_a_cursor_moves_on(spark, lake):
    data = spark.range(30).select("id", F.floor(F.col("id") / 10).alias("at"))
    more = data.unionAll(spark.range(100, 102).select("id", F.lit(None).cast("bigint")))
    source = {"t": Y.Stream("t", lambda: more, ("id",), "at")}
    spec = Y.SyncSpec("t", Y.INCREMENTAL, max_records=3)
    counts = []
    for _ in range(4):
        Y.sync(spark, "s", source, [spec], "cap1", lake, state_namespace="cap1_ops")
        counts.append(lake.read("cap1.t").count())
    assert counts == [12, 22, 32, 32]


def test_a_used_up_cap_leaves_later_tables_alone(spark, lake):
    specs = [Y.SyncSpec("customers"), Y.SyncSpec("orders")]
    Y.sync(spark, "shop", retail(spark), specs, "cap2", lake)
    log = logged(Y.sync(spark, "shop", retail(spark), specs, "cap2", lake, max_records=5))
    assert set(log) == {"customers"} and lake.read("cap2.orders").count() == 50
    log = logged(Y.sync(spark, "shop", retail(spark), specs, "cap2", lake, max_records=9))
    assert log["customers"].succeeded and "replace" in log["orders"].error
    assert lake.read("cap2.orders").count() == 50


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_cursors_do_not_depend_on_the_drivers_zone(spark, lake, monkeypatch, kind):
    data = spark.sql(f"SELECT id, CAST(timestamp_seconds(1e9 + id * 86400) AS {kind}) AS at FROM range(4)")
    grown = iter([data.where("id < 2"), data])
    source = {"t": Y.Stream("t", lambda: next(grown), ("id",), "at")}
    monkeypatch.setenv("TZ", "Asia/Bangkok")
    time.tzset()
    try:
        for _ in range(2):
            log = Y.sync(spark, "s", source, [Y.SyncSpec("t", Y.INCREMENTAL)], "zone", lake, state_namespace="zone_ops")
            assert log.first().succeeded, log.first().error
    finally:
        monkeypatch.undo()
        time.tzset()
    assert log.first().records == 3 and rows(lake.read("zone.t")) == rows(data)


def test_streams_that_would_share_a_table_are_refused(spark, lake):
    one, two = "x" * 70 + "a", "x" * 70 + "b"
    source = {n: Y.Stream(n, lambda: spark.range(1)) for n in (one, two)}
    with pytest.raises(Y.SyncError, match="several streams"):
        Y.sync(spark, "s", source, [Y.SyncSpec(one), Y.SyncSpec(two)], "same", lake)


def cut_source(spark, table, keys=()):
    return {"t": Y.Stream("t", lambda: spark.table(table), keys, "at")}


def held(lake, name):
    return sorted(r.id for r in lake.read(name).collect())


@pytest.mark.parametrize("kind", ["int", "timestamp", "string"])
def test_a_large_sync_is_cut_and_goes_on(spark, lake, kind):
    at = {"int": "CAST(id DIV 3 AS INT)", "timestamp": "timestamp_seconds(id DIV 3)", "string": "format_string('%05d', id DIV 3)"}[kind]
    space = f"cut_{kind}"
    spark.range(300).selectExpr("id", f"if(id = 0, null, {at}) AS at").createOrReplaceTempView("cut_rows")
    source = cut_source(spark, "cut_rows")
    spec = Y.SyncSpec("t", Y.INCREMENTAL, Y.APPEND, inclusive=False, ranges=5, max_ranges=2)
    log = logged(Y.sync(spark, "s", source, [spec], space, lake, state_namespace=f"{space}_ops"))
    part = held(lake, f"{space}.t")
    marks = lake.read(f"{space}_ops.checkpoints").count()
    if kind == "string":  # no quantiles of text: one range
        assert part == list(range(300)) and marks == 1
    else:
        # the first two of five ranges, whole cursors only, the row without a cursor too
        assert part == list(range(len(part))) and 90 <= len(part) <= 150 and len(part) % 3 == 0 and marks == 2
        assert log["t"].records == len(part) and log["t"].succeeded
    for _ in range(2):
        Y.sync(spark, "s", source, [Y.SyncSpec("t", Y.INCREMENTAL, Y.APPEND, inclusive=False, ranges=5)], space, lake, state_namespace=f"{space}_ops")
        assert held(lake, f"{space}.t") == list(range(300))


def test_a_range_that_fails_keeps_the_ones_before(spark, lake):
    source = {"t": Y.Stream("t", lambda: spark.range(100).selectExpr(
        "id", "id AS at", "if(id > 70 AND '{}' = 'bad', raise_error('boom'), id) AS v".format(state["is"])), ("id",), "at")}
    state = {"is": "bad"}
    spec = Y.SyncSpec("t", Y.INCREMENTAL, ranges=4)
    log = logged(Y.sync(spark, "s", source, [spec], "brk", lake, state_namespace="brk_ops"))
    assert not log["t"].succeeded and "boom" in log["t"].error
    part = held(lake, "brk.t")
    assert part == list(range(len(part))) and 40 <= len(part) <= 71
    state["is"] = "good"
    log = logged(Y.sync(spark, "s", source, [spec], "brk", lake, state_namespace="brk_ops"))
    # the boundary is replayed, and merged by key
    assert log["t"].succeeded and log["t"].records == 100 - len(part) + 1 and held(lake, "brk.t") == list(range(100))


def test_ranges_are_checked(spark):
    source = cut_source(spark, "x")
    for wrong in (dict(ranges=0), dict(ranges=2, max_records=5), dict(ranges=2, max_ranges=0)):
        with pytest.raises(Y.SyncError):
            Y.SyncSpec("t", Y.INCREMENTAL, **wrong).resolved(source)
