import pytest
from pyspark.sql import types as T

from millrace import schema as S


def test_type_names_and_unknown_name():
    assert S.type_kind(" VARCHAR ") == "string"
    assert S.type_kind("timestamp with time zone") == "timestamptz"
    assert S.type_kind("jsonb") == "json"
    with pytest.raises(S.SchemaError):
        S.type_kind("interval")


@pytest.mark.parametrize(
    "a,b,wanted",
    [
        ("int", "int", "int"),
        ("int", "double", "double"),
        ("double", "decimal", "decimal"),
        ("long", "float", "float"),
        ("timestamp", "timestamptz", "timestamptz"),
        ("date", "timestamp", "timestamp"),
        ("date", "timestamptz", "string"),
        ("boolean", "int", "string"),
        ("json", "string", "string"),
    ],
)
def test_widening(a, b, wanted):
    assert S.widen(a, b) == S.widen(b, a) == wanted


def test_widening_many_ignores_order():
    assert S.widen_all([]) == "string"
    assert S.widen_all(["double", "int", "long"]) == "double"
    assert S.widen_all(["int", "string"]) == S.widen_all(["string", "int"]) == "string"


def test_duplicates_and_empty_schemas_are_refused():
    with pytest.raises(S.SchemaError):
        S.make_schema([("a", "int"), ("A", "string")])
    with pytest.raises(S.SchemaError):
        S.make_schema({})


def test_evolution_only_adds():
    old = S.make_schema({"id": "long", "name": "string"})
    new = S.make_schema({"ID": "string", "added": "int"})
    grown = S.evolve(old, new)
    assert grown.names == ["id", "name", "added"]
    assert grown["id"].dataType == T.LongType()
    assert S.reconcile(None, new) == new
    assert S.pick(grown, ["ADDED", "id"]).names == ["added", "id"]


def test_json_schema_both_ways():
    document = {
        "properties": {
            "id": {"type": "integer"},
            "ts": {"type": "string", "format": "date-time"},
            "wall": {"type": ["null", "string"], "format": "date-time",
                     "airbyte_type": "timestamp_without_timezone"},
            "meta": {"type": "object"},
            "ok": {"type": "boolean"},
            "big": {"type": "number", "airbyte_type": "big_number"},
            "list": {"type": "array"},
        },
        "required": ["id"],
    }
    schema = S.from_json_schema(document)
    kinds = [S.kind_of(f) for f in schema.fields]
    assert kinds == ["long", "timestamptz", "timestamp", "json", "boolean", "decimal", "json"]
    assert not schema["id"].nullable and schema["ts"].nullable
    assert S.from_json_schema(S.to_json_schema(schema)) == schema


def test_table_names():
    assert S.table_name('"raw"."orders"') == ("raw", "orders")
    assert S.table_name("lake.raw.`orders`") == ("raw", "orders")
    assert S.table_name("orders") == (None, "orders")
    with pytest.raises(S.SchemaError):
        S.table_name("a.b.c.d")


def test_spec_round_trip_and_ddl():
    spec = S.TableSpec(S.make_schema({"id": "long", "doc": "json"}), ("id",), ("bucket(4, id)",), ("id",))
    assert S.TableSpec.from_dict(spec.to_dict()) == spec
    field = S.make_field("d", "decimal", nullable=False, doc="it's", precision=10, scale=2)
    assert S.ddl(T.StructType([field])) == "`d` decimal(10,2) NOT NULL COMMENT 'it\\'s'"
    flat = S.flat(T.StructType([T.StructField("m", T.MapType(T.StringType(), T.LongType()))]))
    assert S.kind_of(flat["m"]) == "json" and flat["m"].dataType == T.StringType()
