import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.functions import cells
from millrace.operators import conform as C

from .conftest import rows

UTC = dt.timezone.utc


def one(spark, value, ddl, kind, **more):
    """A single value read as another type."""
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    target = T.StructType([S.make_field("v", kind, **more)])
    out = C.conform(df, target, on_error="null")
    if kind == "timestamptz":
        out = out.withColumn("v", F.col("v").cast("timestamp_ntz"))
    return out.first()[0]


INSTANT = dt.datetime(2026, 9, 12, 10, 30)


@pytest.mark.parametrize(
    "value,ddl,kind,wanted",
    [
        ("2026-09-12T10:30:00Z", "string", "timestamptz", INSTANT),
        ("2026-09-12T10:30:00+07:00", "string", "timestamptz", dt.datetime(2026, 9, 12, 3, 30)),
        ("2026-09-12 10:30:00", "string", "timestamptz", INSTANT),
        ("2026-09-12T10:30:00Z", "string", "timestamp", INSTANT),
        ("2026-09-12T10:30:00+07:00", "string", "timestamp", INSTANT),
        (1757670000, "bigint", "timestamptz", dt.datetime(2025, 9, 12, 9, 40)),
        (1757670000000, "bigint", "timestamptz", dt.datetime(2025, 9, 12, 9, 40)),
        ("2026-09-12T10:30:00.123456789Z", "string", "timestamptz", INSTANT.replace(microsecond=123456)),
        (dt.date(2026, 9, 12), "date", "timestamptz", dt.datetime(2026, 9, 12)),
        ("2026", "string", "timestamptz", None),
        ("yesterday", "string", "timestamptz", None),
        ("42", "string", "long", 42),
        ("3.9", "string", "long", 3),
        ("-3.9", "string", "long", -3),
        ("9007199254740993", "string", "long", 9007199254740993),
        ("3000000000", "string", "int", None),
        (True, "boolean", "int", 1),
        ("3.5", "string", "double", 3.5),
        ("1_000", "string", "double", 1000.0),
        ("yes", "string", "boolean", True),
        ("0", "string", "boolean", False),
        ("maybe", "string", "boolean", None),
        (2.5, "double", "boolean", True),
        ("1.5", "string", "decimal", Decimal("1.500000000")),
        ("0.0000000005", "string", "decimal", Decimal("0.000000000")),
        ("0.0000000015", "string", "decimal", Decimal("0.000000002")),
        ("2026-09-12", "string", "date", dt.date(2026, 9, 12)),
        ("2026-09-12T23:59:59-05:00", "string", "date", dt.date(2026, 9, 12)),
        ("not-a-number", "string", "long", None),
        (True, "boolean", "string", "True"),
        (7, "int", "string", "7"),
        ("né", "string", "binary", bytearray("né".encode())),
        ({"a": 1}, "map<string,int>", "json", '{"a":1}'),
        ("{}", "string", "json", "{}"),
    ],
)
def test_coercion(spark, value, ddl, kind, wanted):
    assert one(spark, value, ddl, kind) == wanted


def test_time_of_day(spark):
    df = spark.createDataFrame([("10:30:05.5Z",), ("25:00",)], "v string")
    out = C.conform(df, S.make_schema({"v": "time"}), on_error="null")
    assert rows(out.select(F.col("v").cast("string"))) == [("10:30:05.5",), (None,)]


def test_projection_onto_schema(spark):
    df = spark.createDataFrame([("7", "dropped")], "ID string, extra string")
    schema = S.make_schema({"id": "long", "name": "string", "ts": "timestamptz"})
    out = C.conform(df, schema)
    assert out.columns == ["id", "name", "ts"]
    assert rows(out) == [(7, None, None)]


def test_bad_cells_fail_null_or_quarantine(spark):
    df = spark.createDataFrame([(1, "10"), (2, "ten"), (3, None)], "id int, n string")
    schema = S.make_schema({"id": "int", "n": "long"})
    with pytest.raises(Exception, match="column n cannot hold: ten"):
        C.conform(df, schema).collect()
    assert rows(C.conform(df, schema, "null")) == [(1, 10), (2, None), (3, None)]
    good, aside = C.split_quarantine(C.conform(df, schema, "quarantine"))
    assert rows(good) == [(1, 10), (3, None)]
    assert [(r.id, [tuple(c) for c in r["_bad_cells"]]) for r in aside.collect()] == [(2, [("n", "ten")])]
    with pytest.raises(S.SchemaError):
        C.conform(df, schema, "ignore")


def test_cell_kinds_and_values(spark):
    words = [" ", "NULL", "n/a", " True", "+12", "--5", "1_000", "1e5", ".5", "-Inf", "abc", "12x", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, c string")
    found = df.orderBy("i").select(
        cells.cell_kind(F.col("c")), cells.cell_whole(F.col("c")), cells.cell_number(F.col("c")),
        cells.cell_boolean(F.col("c")),
    ).collect()
    assert [r[0] for r in found] == [
        "null", "null", "null", "boolean", "whole", "text", "number", "number", "number", "number",
        "text", "text", "null",
    ]
    assert found[4][1] == 12 and found[6][2] == 1000.0 and found[7][2] == 1e5 and found[3][3] is True


@pytest.mark.parametrize(
    "values,kind",
    [
        (["1", "2"], "int"),
        (["1", "2.5"], "double"),
        (["1", "3000000000"], "long"),
        (["true", "False"], "boolean"),
        (["true", "1"], "string"),
        (["1", "text"], "string"),
        ([None, "1"], "int"),
        (["1", None, ""], "int"),
        (["", None], "string"),
        (["2026-01-01"], "string"),
    ],
)
def test_inference_of_cells(spark, values, kind):
    for order in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in order], "v string")
        assert S.kind_of(C.infer_cells(df)["v"]) == kind


def test_inference_of_typed_rows(spark):
    df = spark.createDataFrame([(1, 3000000000, {"a": 1}, "x")], "a bigint, b bigint, c map<string,int>, d string")
    assert [S.kind_of(f) for f in C.infer(df).fields] == ["int", "long", "json", "string"]


def test_inference_of_json_lines(spark):
    lines = ['{"a":1,"b":"x","c":1.5,"d":true,"e":null}', '{"a":2,"b":"y","c":2,"d":false,"f":[1]}', "broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    kinds = {f.name: S.kind_of(f) for f in C.infer_json(df).fields}
    assert kinds == {"a": "int", "b": "string", "c": "double", "d": "boolean", "e": "string", "f": "json"}


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as n", "if(id % 10 = 0, 'x', '1') as m")
    schema = S.make_schema({"id": "long", "n": "int", "m": "int"})
    first = rows(C.conform(df.repartition(1), schema, "null"))
    assert first == rows(C.conform(df.repartition(17), schema, "null"))


@pytest.mark.parametrize("scale,cases", [
    (0, {"2.5": "2", "3.5": "4", "-0.5": "0", ".5": "0", "1e2": "100", "12345678901234567890123456789012345678": "12345678901234567890123456789012345678"}),
    (2, {"0.125": "0.12", "0.1250000001": "0.13", "0.135": "0.14", "-0.125": "-0.12", "x": None}),
    (9, {"1000000000000000000": "1000000000000000000", "1.5": "1.5"}),
    (18, {"1.5": "1.5", "12345678901234567890.25": "12345678901234567890.25"}),
    (30, {"99999999.5": "99999999.5", "999999999": None}),
])
def test_decimals_of_every_scale(spark, scale, cases):
    schema = T.StructType([S.make_field("text", "string"), S.make_field("d", "decimal", precision=38, scale=scale)])
    df = spark.createDataFrame([(k, k) for k in cases], "text string, d string")
    found = {r.text: r.d for r in C.conform(df, schema, on_error="null").collect()}
    assert found == {k: None if v is None else Decimal(v) for k, v in cases.items()}


def test_objects_used_as_maps_are_refused(spark, monkeypatch):
    from millrace.operators import conform as module

    monkeypatch.setattr(module, "MAX_KEYS", 50)
    lines = spark.range(60).selectExpr("""'{"k' || id % {0} || '":1,"b":true}' AS value""".replace("{0}", "49"))
    assert len(module.infer_json(lines).fields) == 50
    more = spark.range(60).selectExpr("""'{"k' || id || '":1}' AS value""")
    with pytest.raises(module.SchemaError, match="more than 50"):
        module.infer_json(more)
