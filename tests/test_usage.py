import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import dims
from millrace.functions import identifiers, temporal
from millrace.operators import running
from millrace.operators.running import carried, idle_sessions, running_total
from millrace.schema import TableSpec
from millrace.usage import metering, summary

from .conftest import rows

NOON = dt.datetime(2026, 2, 10, 12)

QUERY_LOG = (
    "query_id string, tenant_id string, warehouse_id string, size string, min_clusters int, spot boolean, "
    "wall_seconds double, warehouse_seconds double, bytes_scanned bigint, cache_hit boolean, "
    "provider string, region string, occurred_at timestamp_ntz"
)


def metered(spark, *queries):
    log = spark.createDataFrame(
        [
            (str(i), "t", "w", size, clusters, False, wall, house, 1, hit, "tencent", None, NOON)
            for i, (size, clusters, wall, house, hit) in enumerate(queries)
        ],
        QUERY_LOG,
    )
    out = metering.meter_queries(log, dims.sizes(spark))
    return [r.quantity for r in out.orderBy(F.col("attributes")["query_id"]).collect()]


def test_query_metering(spark):
    found = metered(
        spark,
        ("m", 1, 60.0, 0.0, False),
        ("XS", 0, 0.01, None, False),
        ("m", 1, 60.0, 0.0, True),
        ("m", 2, 5.0, 60.0, False),
        ("m", 1, None, None, False),
    )
    assert found == [D("8"), D("0.033333333"), D("16"), D("0.133333333")]


def test_ten_queries_and_a_sync(spark):
    assert sum(metered(spark, *[("m", 1, 6.0, 0.0, False)] * 10)) == D("8")
    sync = spark.createDataFrame([("t", NOON, 2_000_000_000, 5, "s"), ("t", NOON, 0, 0, "s")],
                                 "tenant_id string, occurred_at timestamp_ntz, bytes_moved bigint, records bigint, source string")
    event = metering.meter_syncs(sync).collect()
    assert [(e.quantity, e.resource_type, e.attributes) for e in event] == [(D("2"), "pipeline", {"rows": "5"})]


def test_storage_is_prorated_by_the_month_of_the_sample(spark):
    at = [dt.datetime(2026, 2, 1), dt.datetime(2024, 2, 1), dt.datetime(2026, 1, 1)]
    df = spark.createDataFrame([("t", 744_000_000_000, 1.0, None, x) for x in at],
                               "tenant_id string, bytes_stored bigint, window_hours double, table_name string, occurred_at timestamp_ntz")
    out = metering.meter_storage(df).orderBy("occurred_at").collect()
    assert [float(r.quantity) for r in out] == pytest.approx([744 / 696, 1.0, 744 / 672])
    assert out[0].resource_type == "lakehouse"
    assert metering.meter_storage(df.withColumn("bytes_stored", F.lit(0))).count() == 0


def test_unit_costs(spark):
    data = [("aws", None, m, s) for m in dims.METER_NAMES for s in (False, True)]
    data += [("aws", "ap-southeast-1", dims.COMPUTE, False), ("tencent", "anywhere", dims.INGEST, False), ("mars", None, dims.COMPUTE, False)]
    df = spark.createDataFrame(data, "provider string, region string, meter string, spot boolean")
    out = metering.with_unit_cost(df, dims.rates(spark), dims.region_indexes(spark))
    cost = {(r.provider, r.region, r.meter, r.spot): r.unit_cost_usd for r in out.collect()}
    assert len(cost) == len(data)
    assert cost["aws", None, dims.COMPUTE, False] == D("0.0008")
    assert cost["aws", None, dims.COMPUTE, True] == D("0.00024")
    assert cost["aws", "ap-southeast-1", dims.COMPUTE, False] == D("0.000912")
    assert cost["aws", None, dims.STORAGE, False] == D("0.023")
    assert cost["aws", None, dims.INGEST, False] == D("0.00004")
    assert cost["aws", None, dims.TASKS, False] == D("0.00068")
    assert cost["aws", None, dims.EGRESS, False] == D("0.09")
    assert cost["aws", None, dims.API, False] == 0
    assert cost["tencent", "anywhere", dims.INGEST, False] == D("0.000012")
    assert cost["mars", None, dims.COMPUTE, False] is None


EVENTS = (
    "id string, tenant_id string, workspace_id string, meter string, quantity decimal(20,9), "
    "occurred_at timestamp_ntz, resource_type string, resource_id string, provider string, unit_cost_usd decimal(16,12)"
)


def events(spark):
    def at(day):
        return dt.datetime(2026, 1, day)

    return spark.createDataFrame(
        [
            ("1", "a", "w1", dims.COMPUTE, D(10), at(1), "warehouse", "x", "aws", D("0.5")),
            ("2", "a", "w1", dims.COMPUTE, D(20), at(2), "warehouse", "y", "gcp", D("0.5")),
            ("3", "a", None, dims.EGRESS, D(4), at(31), None, "z", "aws", D("2")),
            ("4", "a", "w2", dims.EGRESS, D(1), dt.datetime(2026, 2, 1), None, None, "aws", D("2")),
            ("5", "b", "w1", dims.API, D(1), at(3), "route", "", "aws", D("0")),
        ],
        EVENTS,
    )


def test_summary(spark):
    out = summary.summarize(events(spark)).orderBy("tenant_id", "period_start", "meter").collect()
    assert [(r.tenant_id, r.period_start.month, r.meter, r.quantity, r.infra_cost_usd, r.events, r.providers) for r in out] == [
        ("a", 1, dims.COMPUTE, D(30), D(15), 2, ["aws", "gcp"]),
        ("a", 1, dims.EGRESS, D(4), D(8), 1, ["aws"]),
        ("a", 2, dims.EGRESS, D(1), D(2), 1, ["aws"]),
        ("b", 1, dims.API, D(1), D(0), 1, ["aws"]),
    ]


def test_half_open_period_and_filters(spark):
    start, end = F.lit("2026-01-02").cast("timestamp_ntz"), F.lit("2026-02-01").cast("timestamp_ntz")
    ids = lambda **k: [r.id for r in summary.usage_between(events(spark), start, end, **k).orderBy("id").collect()]
    assert ids() == ["2", "3", "5"]
    assert ids(tenant="a") == ["2", "3"]
    assert ids(meter=dims.EGRESS) == ["3"] and ids(workspace="w1") == ["2", "5"]


def test_resources_chargeback_and_last_events(spark):
    top = summary.by_resource(events(spark), 2).filter("tenant_id = 'a'").orderBy("rank").collect()
    assert [(r.resource, r.infra_cost_usd) for r in top] == [("warehouse:y", D(10)), ("resource:z", D(8))]
    level = {(r.tenant_id, r.workspace_id, r.meter, r.level): r.infra_cost_usd for r in summary.chargeback(events(spark)).collect()}
    assert level["a", "w1", dims.COMPUTE, 0] == 15 and level["a", None, None, 3] == 25 and level[None, None, None, 7] == 25
    assert level["a", None, dims.EGRESS, 0] == 8 and level["a", None, None, 1] == 8
    assert [r.id for r in summary.last_events(events(spark), 2).collect()] == ["3", "4"]


def test_dashboard(spark):
    stats = spark.createDataFrame([("a", 3, 10), ("b", 4, 20)], "table_name string, row_count bigint, size_bytes bigint")
    row = summary.dashboard(stats, events(spark)).first()
    assert (row.tables, row.rows, row.bytes, row.usage[dims.COMPUTE]) == (2, 7, 30, D(30))


def sessions_by_hand(times, timeout):
    out, last = [], None
    for t in sorted(times):
        if last is None or (timeout and t - last >= timeout):
            out.append([t, t, 1])
        else:
            out[-1][1:] = [t, out[-1][2] + 1]
        last = t
    return [tuple(x) for x in out]


@pytest.mark.parametrize("timeout", [0, 1, 60, 61, 3600])
def test_idle_sessions_match_brute_force(spark, timeout):
    seconds = {"hot": [x * x % 20011 for x in range(600)], "edge": [0, 60, 120, 181, 181, 3781], "one": [59]}
    base = dt.datetime(2026, 1, 1)
    data = [(k, base + dt.timedelta(seconds=s)) for k, v in seconds.items() for s in v]
    df = spark.createDataFrame(data, "who string, at timestamp_ntz").repartition(7)
    found = idle_sessions(df, ["who"], "at", timeout).collect()
    for who, times in seconds.items():
        mine = sorted(
            ((r.started_at - base).total_seconds(), (r.last_activity_at - base).total_seconds(), r.activities)
            for r in found if r.who == who
        )
        assert mine == sessions_by_hand(times, timeout)


@pytest.mark.parametrize("cuts", [(1000,), (20,), (1,), (100, 10), (100, 20, 1)])
def test_running_totals_over_levels(spark, cuts):
    df = spark.range(500).selectExpr("if(id % 3 = 0, null, id % 2) AS g", "if(id < 7, null, id) AS at", "id", "id % 7 AS v")
    df = df.repartition(5)
    whole = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.withColumn("total", F.sum("v").over(whole))
    levels = [F.floor(F.col("at") / c) for c in cuts]
    assert rows(running_total(df, ["g"], ["at", "id"], "v", "total", levels)) == rows(wanted)
    empty = df.limit(0)
    assert running_total(empty, ["g"], ["at", "id"], "v", "total", levels).collect() == []


@pytest.mark.parametrize("cuts", [(1000,), (7,), (100, 10, 1)])
def test_values_are_carried_over_levels(spark, cuts):
    df = spark.range(400).selectExpr("id % 2 AS g", "id", "if(id % 31 = 3, id, null) AS x", "if(id = 200, 'x', null) AS y").repartition(5)
    along = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("*", *[F.last(c, ignorenulls=True).over(along).alias(f"{c}_now") for c in "xy"])
    levels = [F.floor(F.col("id") / c) for c in cuts]
    found = carried(df, ["g"], ["id"], {"x_now": F.col("x"), "y_now": F.col("y")}, levels)
    assert rows(found) == rows(wanted)


def test_sessions_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(running, "CELLS_PER_SLICE", 3)
    base = dt.datetime(2026, 1, 1)
    rng = random.Random(4)
    seconds = {f"w{k}": sorted(rng.choices(range(5000), k=120)) for k in range(4)}
    data = [(k, base + dt.timedelta(seconds=s)) for k, v in seconds.items() for s in v]
    df = spark.createDataFrame(data, "who string, at timestamp_ntz").repartition(7)
    found = idle_sessions(df, ["who"], "at", 60).collect()
    for who, times in seconds.items():
        mine = sorted((r.session, (r.started_at - base).total_seconds(), (r.last_activity_at - base).total_seconds(), r.activities)
                      for r in found if r.who == who)
        assert [m[1:] for m in mine] == sessions_by_hand(times, 60)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))


def test_time_helpers(spark):
    row = spark.range(1).select(
        *[temporal.format_duration(F.lit(x)) for x in (0.45, 1.25, 184.0, 7620.0)],
        *[temporal.human_bytes(F.lit(x)) for x in (512, 1536, 5 * 1024**2, 3 * 1024**3, 2048 * 1024**4)],
        temporal.seconds_between(F.lit(NOON), F.lit(NOON - dt.timedelta(1))),
        temporal.hours_in_month(F.lit(NOON)),
        temporal.to_iso(F.lit(NOON)),
        temporal.to_iso(temporal.from_iso(F.lit("2026-01-01T07:00:00.5+07:00"))),
    ).first()
    assert list(row) == [
        "450ms", "1.3s", "3m 04s", "2h 07m", "512B", "1.5KB", "5.0MB", "3.0GB", "2048.0TB",
        0.0, 672, "2026-02-10T12:00:00Z", "2026-01-01T00:00:00.500000Z",
    ]


@pytest.mark.parametrize("name,wanted", [("  Daily Revenue! ", "daily_revenue"), ("9 lives", "t_9_lives"),
                                         ("a__b--c", "a_b_c"), ("x" * 80, "x" * 54 + "_46b05b91"), ("x" * 63, "x" * 63), ("_", "x")])
def test_table_names_from_text(spark, name, wanted):
    found = spark.range(1).select(identifiers.slugify(F.lit(name))).first()[0]
    assert found == wanted or (wanted == "x" and found.startswith("x") and len(found) == 5)
    if wanted != "x":
        assert identifiers.slug(name) == found


def test_ids(spark):
    ids = ["usr_01ARZ3NDEKTSV4RRFFQ69G5FAV", "usr_01ARZ3NDEKTSV4RRFFQ69G5FAU", "USR_X", None]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    out = df.select(
        identifiers.is_id(F.col("id")), identifiers.is_id(F.col("id"), "wh"),
        identifiers.id_prefix(F.col("id")), identifiers.id_timestamp_ms(F.col("id")),
    ).collect()
    assert [tuple(r) for r in out] == [(True, False, "usr", 1469922850259), (False, False, None, None),
                                       (False, False, None, None), (False, False, None, None)]


def test_masking(spark):
    config = F.create_map(*[F.lit(x) for x in ("host", "h", "password", "p", "token", "")])
    masked = spark.range(1).select(identifiers.mask_secrets(config, ["password", "token"])).first()[0]
    assert masked == {"host": "h", "password": "***", "token": ""}


def test_periods_of_a_partitioned_log_prune_its_days(spark, lake):
    events = spark.sql("SELECT id, TIMESTAMP_NTZ '2026-01-01' + make_dt_interval(id) AS occurred_at FROM range(9)")
    lake.ensure("log.events", TableSpec(events.schema, partition_by=("days(occurred_at)",)))
    lake.append("log.events", events)
    kept = summary.usage_between(
        lake.read("log.events", derived=True), F.lit(dt.datetime(2026, 1, 3)), F.lit(dt.datetime(2026, 1, 5)))
    assert rows(kept.select("id")) == [(2,), (3,)] and kept.columns == events.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(occurred_at_day" in plan


def test_usage_that_can_not_be_priced_fails(spark):
    log = spark.sql(
        "SELECT 't' tenant_id, TIMESTAMP_NTZ '2026-01-01' occurred_at, 'q' query_id, 'w' warehouse_id, 'huge' size, "
        "1 min_clusters, 5 wall_seconds, 0 warehouse_seconds, 1L bytes_scanned, false cache_hit")
    with pytest.raises(Exception, match="unknown warehouse size: huge"):
        metering.meter_queries(log, dims.sizes(spark)).collect()
    events = spark.sql("SELECT 'nowhere' provider, 'r' region, 'ccu' meter, false spot")
    with pytest.raises(Exception, match="unknown provider: nowhere"):
        metering.with_unit_cost(events, dims.rates(spark), dims.region_indexes(spark), strict=True).collect()


def test_long_names_stay_apart():
    first, second = ("orders of the region " * 4 + end for end in ("north", "south"))
    assert identifiers.slug(first) != identifiers.slug(second)
    assert all(len(identifiers.slug(n)) <= 63 for n in (first, second, "a b" * 40, "_" * 53 + "ab" * 20))
