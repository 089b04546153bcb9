import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.operators.merge import since
from millrace.plans.sync import INCREMENTAL, SyncSpec, sync
from millrace.sources import files, protocol, relational, sample

from .conftest import rows


def write(path, text):
    path.write_text(text)
    return f"file:{path}"


def test_formats_by_ending():
    assert files.file_format("http://x/a.TSV?key=1.json") == "tsv"
    assert files.file_format("a.ndjson") == "jsonl"
    assert files.file_format("a.json") == "json"
    assert files.file_format("a.txt") == "csv"
    assert files.file_format("a.txt", "JSONL") == "jsonl"


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,amount,ok,note\n1, 2.5 ,true,"a,b"\n2,n/a,FALSE,,surplus\n\n')
    df = files.read_file(spark, path)
    assert [S.kind_of(f) for f in df.schema.fields] == ["int", "double", "boolean", "string"]
    assert rows(df) == [(1, 2.5, True, "a,b"), (2, None, False, None)]


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,note\n1,"two\nlines"\n')
    assert rows(files.read_csv(spark, path, multi_line=True)) == [(1, "two\nlines")]


def test_tsv_with_declared_schema(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "id\tday\n1\t2026-01-02\n")
    df = files.read_csv(spark, path, "\t", schema=S.make_schema({"id": "long", "day": "date"}))
    assert [str(v) for v in df.first()] == ["1", "2026-01-02"]


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"id": 1, "tags": ["x"]}\n\n{"id": 2.5, "extra": "y"}\n')
    assert rows(files.read_file(spark, path)) == [("y", 2.5, None), (None, 1.0, '["x"]')]


@pytest.mark.parametrize(
    "text,path,wanted",
    [
        ('[{"a":1},{"a":2}]', None, [(1,), (2,)]),
        ('{"a":1}', None, [(1,)]),
        ('{"data":{"items":[{"a":1},{"a":2}]}}', "data.items", [(1,), (2,)]),
        ('{"data":{"items":{"a":5}}}', "data.items", [(5,)]),
        ('{"data":{}}', "data.items", []),
    ],
)
def test_json_documents(spark, tmp_path, text, path, wanted):
    docs = files.read_json_documents(spark, write(tmp_path / "a.json", text), path)
    assert rows(docs.select(F.variant_get("doc", "$.a", "int"))) == wanted


@pytest.mark.parametrize("text,path", [('{"data":[1]}', "data.items"), ('{"data":7}', "data"), ('"x"', None)])
def test_json_documents_of_another_shape_are_errors(spark, tmp_path, text, path):
    docs = files.read_json_documents(spark, write(tmp_path / "a.json", text), path)
    with pytest.raises(Exception, match="record"):
        docs.collect()


def test_json_file_as_table(spark, tmp_path):
    path = write(tmp_path / "a.json", '{"rows":[{"id":1,"ok":true},{"id":2,"ok":false}]}')
    assert rows(files.read_file(spark, path, record_path="rows")) == [(1, True), (2, False)]


def test_empty_relation(spark):
    df = files.empty_relation(spark, S.make_schema({"id": "long", "at": "timestamptz"}))
    assert df.count() == 0 and df.dtypes == [("id", "bigint"), ("at", "timestamp")]


LINES = [
    '{"type":"RECORD","record":{"stream":"orders","data":{"id":1,"at":"2026-01-01T00:00:00Z"},"emitted_at":5}}',
    '{"type":"RECORD","record":{"stream":"orders","data":{"id":"2","meta":{"a":1}},"emitted_at":6}}',
    '{"type":"RECORD","record":{"stream":"other","data":{"id":3},"namespace":"side"}}',
    '{"type":"RECORD","record":{"data":{"id":9}}}',
    '{"type":"STATE","state":{"data":{"orders":{"cursor":"x"}},"stream":"orders"}}',
    '{"type":"CONNECTION_STATUS","connectionStatus":{"status":"SUCCEEDED"}}',
    '{"type":"CONNECTION_STATUS","connection_status":{"status":"FAILED"}}',
    '{"type":"LOG","log":{"level":"INFO"}}',
    '{"type":"NEWS"}',
    "not json at all",
    "",
    '{"broken":',
    "[1]",
]


def test_protocol_messages(spark):
    found = protocol.parse_messages(spark.createDataFrame([(x,) for x in LINES], "value string"))
    kinds = [r.type for r in found.collect()]
    assert sorted(kinds) == ["CONNECTION_STATUS"] * 2 + ["LOG"] + ["RECORD"] * 3 + ["STATE"]
    status = found.filter("type = 'CONNECTION_STATUS'").select(F.to_json("payload"))
    assert rows(status) == [('{"status":"FAILED"}',), ('{"status":"SUCCEEDED"}',)]
    schema = S.make_schema({"id": "long", "at": "timestamp", "meta": "json"})
    out = protocol.stream_records(found, "orders", schema)
    assert [(r.id, r.meta, r["_emitted_at"]) for r in out.orderBy("id").collect()] == [
        (1, None, 5), (2, '{"a":1}', 6),
    ]
    states = protocol.last_states(found.withColumn("seq", F.lit(1)), "seq")
    assert rows(states) == [("orders", '{"orders":{"cursor":"x"}}')]


def test_protocol_lines_round_trip(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, name string")
    lines = protocol.record_lines(df, "things", F.lit(9))
    assert rows(lines)[0] == (
        '{"type":"RECORD","record":{"stream":"things","data":{"id":1},"emitted_at":9}}',
    )
    both = lines.unionByName(protocol.state_line(spark, "things", "2"))
    found = protocol.parse_messages(both)
    back = protocol.stream_records(found, "things", S.make_schema({"id": "int", "name": "string"}))
    assert rows(back.drop("_emitted_at")) == [(1, None), (2, "b")]


def test_sample_is_the_same_under_any_partitioning(spark):
    first = sample.orders(spark, 200)
    assert rows(first) == rows(sample.orders(spark, 200).repartition(7))
    assert rows(first) != rows(sample.orders(spark, 200, seed=43))
    checks = first.agg(
        F.min("quantity"), F.max("quantity"), F.countDistinct("sku"),
        F.bool_and(F.col("amount") == F.round(F.col("quantity") * F.col("unit_price"), 2)),
    ).first()
    assert 1 <= checks[0] <= checks[1] <= 12 and checks[2] == 5 and checks[3]
    assert sample.customers(spark).count() == 5


def test_incremental_bounds(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "c bigint")
    assert rows(since(df, "c", 2)) == [(2,), (3,)]
    assert rows(since(df, "c", 2, inclusive=False)) == [(3,)]
    assert since(df, "c", None).count() == 4


def test_jdbc_options():
    db = relational.Database("jdbc:x", driver="d", session_init="SET READ ONLY")
    options = db.options(relational.Split("id", 0, 100, 4))
    assert options["fetchsize"] == "5000" and options["numPartitions"] == "4"
    assert options["sessionInitStatement"] == "SET READ ONLY"
    assert "'it''s'" in relational.discovery_query(["it's"])


def test_default_cursor_and_names():
    schema = S.make_schema({"note": "string", "id": "long", "created_at": "timestamptz"})
    assert relational.default_cursor(schema) == "created_at"
    assert relational.default_cursor(S.make_schema({"a": "string", "n": "int"})) == "n"
    assert relational.default_cursor(S.make_schema({"a": "string"})) is None
    assert relational.stream_name("public", "t") == "t"
    assert relational.stream_name("shop", "t") == "shop_t"


def test_described_streams(spark):
    ddl = (
        "table_schema string, table_name string, column_name string, ordinal_position int, "
        "data_type string, is_nullable string, key_position int"
    )
    found = relational.describe_streams(
        spark.createDataFrame(
            [
                ("public", "t", "b", 2, "text", "YES", None),
                ("public", "t", "a", 1, "bigint", "NO", 1),
                ("public", "t", "updated_at", 3, "timestamp with time zone", "YES", None),
                ("shop", "u", "x", 1, "text", "YES", None),
            ],
            ddl,
        )
    ).orderBy("name").collect()
    assert [(r.name, r["keys"], r.cursor, r.incremental) for r in found] == [
        ("shop_u", [], None, False), ("t", ["a"], "updated_at", True),
    ]
    assert [c["name"] for c in found[1]["columns"]] == ["a", "b", "updated_at"]


def test_stream_of_unknown_namespace(spark, lake):
    lake.ensure("disc.t", S.TableSpec(S.make_schema({"id": "long", "n": "string"})))
    assert relational.discover_catalog(spark, "disc") == [
        {"name": "t", "columns": ["id", "n"], "nullable": [True, True], "cursor": "id"}
    ]


def test_types_stay(spark):
    assert isinstance(sample.orders(spark, 1).schema["ordered_at"].dataType, T.TimestampType)


def message(stream, **parts):
    kind = "STATE" if "state" in parts else "RECORD"
    name = '"stream":"%s",' % stream if stream else ""
    data = parts.get("state", parts.get("record"))
    return f'{{"type":"{kind}","{kind.lower()}":{{{name}"data":{data}}}}}'


def test_states_commit_what_stands_before_them(spark, tmp_path):
    first = ["noise", message("a", record='{"id":1}'), message("b", record='{"id":1}'), message("a", state='{"c":1}'),
             message(None, state='{"all":1}'), message("a", record='{"id":2}')]
    second = [message("b", state='{"c":5}'), message("b", record='{"id":2}'), message("a", record='{"id":3}'),
              message("a", state='{"c":3}'), message("a", record='{"id":4}')]
    for name, lines in (("part-0", first), ("part-1", second)):
        write(tmp_path / name, "\n".join(lines) + "\n")
    messages = protocol.parse_messages(protocol.read_log(spark, f"file:{tmp_path}"), keep=["position"])
    found = protocol.committed_states(messages)
    assert rows(found.select("stream", "state", "records")) == [
        ("a", '{"c":1}', 1), ("a", '{"c":3}', 3), ("b", '{"c":5}', 1), (None, '{"all":1}', 2),
    ]
    assert rows(protocol.resume_points(found)) == [("a", '{"c":3}', 3), ("b", '{"c":5}', 1), (None, '{"all":1}', 2)]
    for cap, wanted in ((2, []), (3, ["1", "all"]), (4, ["1", "5", "all"]), (6, ["1", "3", "5", "all"]), (100, ["1", "3", "5", "all"])):
        kept = protocol.committed_states(messages, max_records=cap)
        assert sorted(r.state[-2] if "c" in r.state else "all" for r in kept.collect()) == wanted, cap


def test_states_of_a_log_in_many_blocks(spark, tmp_path):
    lines = [message("s", record='{"id":%d,"pad":"%s"}' % (i, "x" * 50)) if i % 7 else message("s", state=f'{{"c":{i}}}') for i in range(1, 3000)]
    write(tmp_path / "log", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        messages = protocol.parse_messages(protocol.read_log(spark, f"file:{tmp_path}"), keep=["position"])
        found = {int(r.state[5:-1]): r.records for r in protocol.committed_states(messages).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: i - i // 7 for i in range(7, 3000, 7)}


def test_counting_a_log_never_broadcasts_its_rows(spark, tmp_path):
    """Parsed messages seem a hundredth of their size to the planner; their rows must not pass the driver."""
    lines = [message("s", record='{"id":%d}' % i) if i % 5 else message("s", state=f'{{"c":{i}}}') for i in range(1, 2000)]
    write(tmp_path / "log", "\n".join(lines))
    messages = protocol.parse_messages(protocol.read_log(spark, f"file:{tmp_path}"), keep=["position"])
    found = protocol.committed_states(messages, max_records=1000)
    assert len(found.collect()) == 249  # record 1000 is line 1249
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_log_is_a_source_of_syncs(spark, lake, tmp_path):
    lines = [message("a", record='{"id":1,"v":"x"}'), message("b", record='{"id":9}'), message("a", record='{"id":1,"v":"x"}'),
             message("a", record='{"id":2,"v":"y"}')]
    write(tmp_path / "log", "\n".join(lines))
    messages = protocol.parse_messages(protocol.read_log(spark, f"file:{tmp_path}"))
    schemas = {"a": S.make_schema({"id": "long", "v": "string"}), "b": S.make_schema({"id": "long"})}
    source = protocol.log_streams(messages, schemas, {"a": ["id"]})
    sync(spark, "log", source, [SyncSpec("a", INCREMENTAL), SyncSpec("b")], "fromlog", lake, state_namespace="fromlog_ops")
    assert rows(lake.read("fromlog.a")) == [(1, "x", 0), (2, "y", 0)] and rows(lake.read("fromlog.b")) == [(9, 0)]
