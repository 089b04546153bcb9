import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.operators.merge import last_wins, merge_frames
from millrace.operators.partitioning import transform_column, with_partitions
from millrace.plans.tables import _of_partitions
from millrace.schema import SchemaError, TableSpec

from .conftest import rows


def frame(spark, data, ddl="id bigint, amount double"):
    return spark.createDataFrame(data, ddl)


TARGET = [(1, 10.0), (2, 20.0)]


def test_upsert_frames(spark):
    out = merge_frames(frame(spark, TARGET), frame(spark, [(1, 99.0)]), ["id"])
    assert rows(out) == [(1, 99.0), (2, 20.0)]


def test_last_record_of_a_key_wins(spark):
    batch = frame(spark, [(1, 5.0, 1), (1, 7.0, 3), (1, 6.0, 2), (3, 1.0, 1)], "id bigint, amount double, seq int")
    for parts in (1, 5):
        assert rows(last_wins(batch.repartition(parts), ["id"], ["seq"])) == [(1, 7.0, 3), (3, 1.0, 1)]


def test_last_wins_keeps_nulls_and_maps(spark):
    batch = frame(spark, [(1, None, {"a": 1}, 2), (1, "x", {"b": 2}, 1)], "id int, t string, m map<string,int>, seq int")
    assert rows(last_wins(batch, ["id"], ["seq"])) == [(1, None, {"a": 1}, 2)]


def test_null_keys(spark):
    target, batch = frame(spark, [(None, 1.0), (2, 2.0)]), frame(spark, [(None, 9.0)])
    assert rows(merge_frames(target, batch, ["id"])) == [(2, 2.0), (None, 9.0)]
    never = merge_frames(target, batch, ["id"], null_safe=False)
    assert rows(never) == [(2, 2.0), (None, 1.0), (None, 9.0)]


def test_merge_of_a_key_only_table_and_without_keys(spark):
    one, two = frame(spark, [(1,), (2,)], "id int"), frame(spark, [(2,), (3,)], "id int")
    assert rows(merge_frames(one, two, ["id"], null_safe=False)) == [(1,), (2,), (3,)]
    assert merge_frames(one, two, []).count() == 4


def test_merge_is_idempotent_and_does_not_depend_on_partitioning(spark):
    target = spark.range(200).selectExpr("id", "id * 1.0D AS amount")
    batch = spark.range(100, 300).selectExpr("id", "id * 2.0D AS amount")
    once = merge_frames(target, batch, ["id"], ["amount"])
    twice = merge_frames(once, batch, ["id"], ["amount"])
    assert rows(once) == rows(twice)
    assert rows(once) == rows(merge_frames(target.repartition(17), batch.repartition(3), ["id"], ["amount"]))


def test_table_life(spark, lake):
    table = "space.things"
    spec = TableSpec(S.make_schema({"id": "long", "amount": "double"}), ("id",))
    assert lake.ensure(table, spec) and not lake.ensure(table, spec)
    assert lake.exists(table) and lake.read(table).count() == 0
    done = lake.append(table, frame(spark, TARGET))
    assert (done.rows, done.bytes_moved) == (2, len('{"id":1,"amount":10.0}') * 2)
    lake.upsert(table, frame(spark, [(1, 99.0)]), ["id"])
    assert rows(lake.read(table)) == [(1, 99.0), (2, 20.0)]
    lake.overwrite(table, frame(spark, [(5, 5.0)]))
    assert rows(lake.read(table)) == [(5, 5.0)]
    lake.overwrite(table, frame(spark, []))
    assert rows(lake.read(table)) == []
    assert lake.tables("space") == ["things"]
    assert lake.drop_old_versions(table) >= 2
    with pytest.raises(Exception):
        lake.drop_namespace("space")
    lake.drop(table)
    assert not lake.exists(table)
    with pytest.raises(SchemaError):
        lake.create("space.none", TableSpec(S.T.StructType([])))


def test_additive_evolution(spark, lake):
    table = "evo.t"
    lake.ensure(table, TableSpec(S.make_schema({"id": "long"})))
    lake.append(table, frame(spark, [(1,)], "id bigint"))
    assert lake.ensure(table, TableSpec(S.make_schema({"ID": "long", "added": "string"})))
    lake.append(table, frame(spark, [(2, "x")], "id bigint, added string"))
    assert not lake.ensure(table, TableSpec(S.make_schema({"id": "long"})))
    lake.append(table, frame(spark, [(3,)], "id bigint"))
    assert lake.read(table).columns == ["id", "added"]
    assert rows(lake.read(table)) == [(1, None), (2, "x"), (3, None)]


def test_self_overwrite(spark, lake):
    lake.ensure("me.t", TableSpec(S.make_schema({"id": "long"})))
    lake.append("me.t", frame(spark, [(1,), (2,)], "id bigint"))
    lake.overwrite("me.t", lake.read("me.t").filter("id > 1"))
    assert rows(lake.read("me.t")) == [(2,)]


DAYS = [(1, "a", "2026-01-01"), (2, "b", "2026-01-01"), (3, "c", "2026-01-02"), (4, "d", "2026-02-01")]


def days(spark, data):
    return spark.createDataFrame(data, "id int, name string, d string").withColumn("d", F.to_date("d"))


def files_by_month(lake, table):
    listed = lake.files(table).collect()
    return {r["path"].rsplit("/", 2)[1]: r["path"] for r in listed}


def test_partitioned_upsert_rewrites_only_touched_partitions(spark, lake):
    table = "part.t"
    spec = TableSpec(days(spark, DAYS).schema, ("id",), ("months(d)",), ("id",))
    lake.ensure(table, spec)
    lake.append(table, days(spark, DAYS))
    before = files_by_month(lake, table)
    assert set(before) == {"d_month=2026-01-01", "d_month=2026-02-01"}
    lake.upsert(table, days(spark, [(1, "z", "2026-01-05"), (9, "n", "2026-01-09")]), ["id"])
    after = files_by_month(lake, table)
    assert before["d_month=2026-02-01"] == after["d_month=2026-02-01"]
    assert before["d_month=2026-01-01"] != after["d_month=2026-01-01"]
    assert sorted((r.id, r.name) for r in lake.read(table).collect()) == [
        (1, "z"), (2, "b"), (3, "c"), (4, "d"), (9, "n"),
    ]
    # The only February row moves to March: its old partition must not keep it.
    lake.upsert(table, days(spark, [(4, "m", "2026-03-03")]), ["id"])
    assert set(files_by_month(lake, table)) == {"d_month=2026-01-01", "d_month=2026-03-01"}
    assert rows(lake.read(table).filter("id = 4").select("name", "d")) == [("m", dt.date(2026, 3, 3))]


def test_partitioned_overwrite(spark, lake):
    table = "part.o"
    lake.ensure(table, TableSpec(days(spark, DAYS).schema, ("id",), ("d",)))
    lake.append(table, days(spark, DAYS))
    lake.overwrite(table, days(spark, DAYS[3:]))
    assert [r.id for r in lake.read(table).collect()] == [4]
    assert lake.spec(table).partition_by == ("d",)


@pytest.mark.parametrize("partition_by", [(), ("name",)])
def test_compaction_keeps_rows_and_ends(spark, lake, partition_by):
    table = "comp.t"
    df = spark.range(300).selectExpr("id", "concat('p', id % 3) AS name")
    lake.ensure(table, TableSpec(df.schema, ("id",), partition_by, ("id",)))
    for part in range(4):
        lake.append(table, df.filter(f"id % 4 = {part}").repartition(3))
    before, count = rows(lake.read(table)), lake.files(table).count()
    assert lake.compact(table)
    assert rows(lake.read(table)) == before
    assert lake.files(table).count() == (3 if partition_by else 1) < count
    assert not lake.compact(table)


def test_stats(spark, lake):
    lake.ensure("stat.a", TableSpec(S.make_schema({"id": "long", "n": "int"})))
    lake.append("stat.a", frame(spark, [(1, 2), (2, 3)], "id bigint, n int"))
    lake.ensure("stat.b", TableSpec(S.make_schema({"id": "long"})))
    lake.ensure("stat._stage_c", TableSpec(S.make_schema({"id": "long"})))
    found = {r.table_name: r for r in lake.stats("stat").collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"].row_count, found["a"].columns, found["b"].row_count, found["b"].size_bytes) == (2, 2, 0, 0)
    assert found["a"].size_bytes == sum(r.length for r in lake.files("stat.a").collect()) > 0


def test_partition_expressions(spark):
    df = spark.createDataFrame([(17, "hello", dt.datetime(2026, 3, 4, 5, 6))], "n bigint, s string, ts timestamp_ntz")
    out, names = with_partitions(
        df, ["year(ts)", "months(ts)", "days(ts)", "hour(ts)", "truncate(5, n)", "truncate(s, 2)", "identity(n)"]
    )
    row = out.first()
    assert names == ["ts_year", "ts_month", "ts_day", "ts_hour", "n_trunc", "s_trunc", "n"]
    assert [row[c] for c in names] == [
        dt.date(2026, 1, 1), dt.date(2026, 3, 1), dt.date(2026, 3, 4), "2026-03-04-05", 15, "he", 17,
    ]
    name, column = transform_column(df, "bucket(n, 8)")
    assert name == "n_bucket" and 0 <= df.select(column).first()[0] < 8
    assert transform_column(df, "bucket(8, n)")[0] == "n_bucket"
    for wrong in ("shuffle(n)", "bucket(n)", "days(n, ts)", "nothing"):
        with pytest.raises(SchemaError):
            transform_column(df, wrong)


def test_a_missing_partition_value_can_be_left(spark, lake):
    ddl = "id int, p string"
    lake.ensure("part.n", TableSpec(spark.createDataFrame([], ddl).schema, ("id",), ("p",)))
    lake.append("part.n", spark.createDataFrame([(1, None), (2, "a")], ddl))
    lake.upsert("part.n", spark.createDataFrame([(1, "a")], ddl), ["id"])
    assert rows(lake.read("part.n").select("id", "p")) == [(1, "a"), (2, "a")]
    lake.upsert("part.n", spark.createDataFrame([(2, None)], ddl), ["id"])
    assert rows(lake.read("part.n").select("id", "p")) == [(1, "a"), (2, None)]


KEYED = "id bigint, v string, seq int, part string, sub int"


def by_hand(target, batch):
    kept = {r[0]: r for r in target}
    for r in sorted(batch, key=lambda r: r[2]):
        kept[r[0]] = r
    return sorted(kept.values(), key=repr)


def test_upsert_touches_only_partitions_with_incoming_keys(spark, lake):
    target = [(i, "old", 0, f"p{i % 5}" if i % 7 else None, i % 2) for i in range(60)]
    # keys that stay, keys that move on, new keys, a partition that loses all its rows, one that nothing touches
    batch = [(i, "new", 1, f"p{i % 5}" if i % 7 else None, i % 2) for i in range(0, 20, 5)]
    batch += [(i, "moved", 2, "p9", 0) for i in range(60) if i % 5 == 3 and i % 7]
    batch += [(100, "fresh", 1, None, None), (101, "fresh", 1, "p1", 1)]
    spec = TableSpec(S.make_schema({"id": "long", "v": "string", "seq": "int", "part": "string", "sub": "int"}), ("id",), ("part", "sub"))
    lake.ensure("up.t", spec)
    lake.append("up.t", frame(spark, target, KEYED))
    before = {r.uri for r in lake.files("up.t").collect()}
    lake.upsert("up.t", frame(spark, batch, KEYED), ["id"], ["seq"])
    assert rows(lake.read("up.t")) == by_hand(target, batch)
    after = {r.uri for r in lake.files("up.t").collect()}
    untouched = [u for u in before if "part=p2" in u or "part=p4" in u]
    assert untouched and set(untouched) <= after
    assert not any("part=p3" in u for u in after) and any("part=p3" in u for u in before)
    again = lake.upsert("up.t", frame(spark, batch, KEYED), ["id"], ["seq"])
    assert again.rows == len(batch) and rows(lake.read("up.t")) == by_hand(target, batch)


def test_touched_partitions_prune_the_scan(spark, lake):
    spec = TableSpec(S.make_schema({"id": "long", "part": "int"}), ("id",), ("part",))
    lake.ensure("prune.t", spec)
    lake.append("prune.t", spark.range(40).selectExpr("id", "CAST(id % 8 AS INT) AS part"))
    touched = spark.createDataFrame([(3, 1, 0, 0)], "part int, _leave int, _stay int, _enter int")
    found = _of_partitions(spark.table("prune.t"), touched, ["part"])
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert rows(found.select("id")) == [(i,) for i in sorted(range(3, 40, 8), key=lambda i: repr((i,)))]


@pytest.mark.parametrize("mode", ["append", "overwrite", "upsert"])
def test_rejected_rows_go_to_a_table_of_their_own(spark, lake, mode):
    spec = TableSpec(S.make_schema({"id": "long", "amount": "double", "on": "date"}), ("id",))
    table = f"rej.{mode}"
    lake.ensure(table, spec)
    raw = frame(spark, [("1", "2.5", "2026-01-01"), ("x", "1", "2026-01-02"), ("3", "much", "never"), ("4", None, None)],
                "id string, amount string, on string")
    more = {"keys": ["id"]} if mode == "upsert" else {}
    for nth in (1, 2):
        done = getattr(lake, mode)(table, raw, on_error="quarantine", **more)
        assert (done.rows, done.rejected) == (2, 2)
        bad = lake.read(lake.rejects(table))
        assert bad.count() == 2 * nth
    assert rows(bad.select("id", "amount", "_bad_cells").distinct()) == [
        (3, None, '[{"column":"amount","value":"much"},{"column":"on","value":"never"}]'),
        (None, 1.0, '[{"column":"id","value":"x"}]'),
    ]
    assert lake.read(table).count() == (4 if mode == "append" else 2)
    clean = getattr(lake, mode)(f"rej.{mode}", raw.where("id = '4'"), on_error="quarantine", **more)
    assert clean.rejected == 0 and lake.read(lake.rejects(table)).count() == 4
    leftovers = [f for f in lake.files(table).collect() if "aside" in f.path or "stage" in f.path]
    assert not leftovers


def test_statistics_of_many_tables_are_two_scans(spark, lake):
    for k in range(4):
        df = spark.range(10 * k).selectExpr("id", "id * 2 AS b", "CAST(id % 2 AS INT) AS p")
        lake.ensure(f"many.t{k}", TableSpec(df.schema, (), ("p",) if k % 2 else ()))
        lake.append(f"many.t{k}", df)
    spark.sql("CREATE VIEW many.v AS SELECT * FROM many.t1")
    found = lake.stats("many")
    sizes = {r.table_name: r for r in found.collect()}
    assert {n: (r.row_count, r.columns) for n, r in sizes.items()} == {f"t{k}": (10 * k, 3) for k in range(4)}
    for k in range(4):
        assert sizes[f"t{k}"].size_bytes == sum(f.length for f in lake.files(f"many.t{k}").collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert rows(lake.stats("default").select("table_name")) == []
