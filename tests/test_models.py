import datetime as dt

import pytest

from millrace.operators.summaries import last_rows, preview, share_of_total, suggest_summary, top_per_group
from millrace.plans import models as M

from .conftest import rows


def by_name(*models):
    return {m.name: m for m in models}


def statuses(df):
    return {r.model: r.status for r in df.collect()}


def test_compile_references():
    base = M.Model("Base Model", "SELECT 1 AS id;")
    inline = M.Model("inline", "SELECT id FROM {{ ref('base_model') }}", M.EPHEMERAL)
    user = M.Model("user", "SELECT * FROM {{ ref( 'inline' ) }} JOIN {{ source('raw', \"t\") }} USING (id)")
    models = by_name(base, inline, user)
    assert M.compile_model(base, models) == "SELECT 1 AS id"
    assert M.compile_model(user, models) == (
        "SELECT * FROM (SELECT id FROM `analytics`.`base_model`) JOIN `raw`.`t` USING (id)"
    )
    assert M.compile_model(M.Model("x", "FROM {{ ref('unknown') }}")) == "FROM `analytics`.`unknown`"
    assert M.parents(user) == ["inline"] and M.sources_of(user) == [("raw", "t")]


def test_compile_variables_and_incremental_blocks():
    model = M.Model(
        "m",
        "SELECT * FROM t {% if is_incremental() %} WHERE at > (SELECT max(at) FROM {{ this }}) {% endif %}"
        "LIMIT {{ var('limit', 10) }}",
    )
    assert M.compile_model(model) == "SELECT * FROM t LIMIT 10"
    out = M.compile_model(model, variables={"limit": 99}, incremental=True)
    assert "max(at) FROM `analytics`.`m`" in out and out.endswith("LIMIT 99")
    with pytest.raises(M.ModelError, match="needs variable"):
        M.compile_model(M.Model("m", "SELECT {{ var('x') }}"))
    assert M.literal("it's") == "'it\\'s'" and M.literal(None) == "NULL" and M.literal(True) == "TRUE"


def test_order_selection_and_cycles():
    a, b = M.Model("a", "SELECT 1 AS id"), M.Model("b", "SELECT * FROM {{ ref('A') }}")
    c = M.Model("c", "SELECT * FROM x", depends_on=("b",))
    assert M.build_order([c, b, a]) == ["a", "b", "c"]
    assert M.build_order([c, b, a], ["b"]) == ["a", "b"]
    with pytest.raises(M.ModelError, match="unknown"):
        M.build_order([a], ["z"])
    with pytest.raises(M.ModelError, match="each other"):
        M.build_order([M.Model("p", "{{ ref('q') }}"), M.Model("q", "{{ ref('p') }}")])


def test_materialisations(spark, lake):
    models = [
        M.Model("base", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, name)", namespace="m1"),
        M.Model("skin", "SELECT id FROM {{ ref('base') }}", M.VIEW, namespace="m1"),
        M.Model("hidden", "SELECT id * 10 AS id FROM {{ ref('skin') }}", M.EPHEMERAL, namespace="m1"),
        M.Model("top", "SELECT max(id) AS id FROM {{ ref('hidden') }}", namespace="m1"),
    ]
    result = M.run_models(lake, models, parallel=3)
    assert set(statuses(result).values()) == {"succeeded"}
    assert {r.model: r.rows for r in result.collect()} == {"base": 2, "skin": None, "hidden": None, "top": 1}
    assert rows(spark.table("m1.top")) == [(20,)] and lake.tables("m1") == ["base", "skin", "top"]
    edges = rows(M.lineage(spark, models))
    assert ("m1.base", "m1.skin", "model") in edges and len(edges) == 3


def test_incremental_merge_append_and_full_refresh(spark, lake):
    keyed = M.Model("keyed", "SELECT 1 AS id, {{ var('v') }} AS v", M.INCREMENTAL, "m2", ("id",))
    plain = M.Model("plain", "SELECT {{ var('v') }} AS v", M.INCREMENTAL, "m2")
    for value in (1, 2):
        M.run_models(lake, [keyed, plain], variables={"v": value})
    assert rows(lake.read("m2.keyed")) == [(1, 2)] and rows(lake.read("m2.plain")) == [(1,), (2,)]
    M.run_models(lake, [plain], variables={"v": 3}, full_refresh=True)
    assert rows(lake.read("m2.plain")) == [(3,)]


def test_incremental_model_gains_columns_and_table_changes_shape(spark, lake):
    one = M.Model("t", "SELECT 1 AS id", M.INCREMENTAL, "m3", ("id",))
    two = M.Model("t", "SELECT 2 AS id, 'x' AS more", M.INCREMENTAL, "m3", ("id",))
    M.run_models(lake, [one])
    M.run_models(lake, [two])
    assert rows(lake.read("m3.t")) == [(1, None), (2, "x")]
    M.run_models(lake, [M.Model("t", "SELECT 'y' AS other", namespace="m3")])
    assert rows(lake.read("m3.t")) == [("y",)] and lake.read("m3.t").columns == ["other"]
    assert lake.tables("m3") == ["t"]


def test_partitioned_model(spark, lake):
    model = M.Model("p", "SELECT id, id % 2 AS half FROM range(10)", namespace="m4", partition_by=("half",))
    M.run_models(lake, [model])
    M.run_models(lake, [model])
    assert lake.read("m4.p").count() == 10
    assert {r.path.rsplit("/", 2)[1] for r in lake.files("m4.p").collect()} == {"half=0", "half=1"}


def test_failures_skip_dependents_and_tests_fail_models(spark, lake):
    models = [
        M.Model("broken", "SELECT * FROM no_such_table", namespace="m5"),
        M.Model("child", "SELECT * FROM {{ ref('broken') }}", namespace="m5"),
        M.Model("twice", "SELECT 1 AS id UNION ALL SELECT 1", namespace="m5",
                tests=({"type": "unique", "column": "id"}, {"type": "not_null", "column": "id"})),
        M.Model("fine", "SELECT 1 AS id UNION ALL SELECT 2", namespace="m5",
                tests=({"type": "unique", "column": "id"},
                       {"type": "accepted_values", "column": "id", "values": [1, 2]},
                       {"type": "sql", "name": "none above", "sql": "SELECT * FROM m5.fine WHERE id > 5"})),
        M.Model("odd", "SELECT 1 AS id", namespace="m5", tests=({"type": "not_null", "column": "zzz"},)),
    ]
    result = {r.model: r for r in M.run_models(lake, models).collect()}
    assert {k: r.status for k, r in result.items()} == {
        "broken": "failed", "child": "skipped", "twice": "failed", "fine": "succeeded", "odd": "failed",
    }
    assert result["twice"].failures == ["unique(id): 1"] and "broken" in result["child"].error
    assert "errored" in result["odd"].failures[0]


def test_dry_run_builds_nothing(spark, lake):
    out = M.run_models(lake, [M.Model("d", "SELECT 1 AS id", namespace="m6")], dry_run=True)
    assert statuses(out) == {"d": "compiled"} and not lake.exists("m6.d")


def test_sql_with_parameters_and_limit(spark):
    assert rows(M.run_sql(spark, "SELECT id FROM range(10) WHERE id >= :low", {"low": 8})) == [(8,), (9,)]
    assert M.run_sql(spark, "SELECT * FROM range(10)", limit=3).count() == 3


def test_summaries(spark):
    df = spark.createDataFrame(
        [(1, "acme", 120.5, "TH"), (2, "globex", 80.0, "SG"), (3, "acme", 45.25, "TH")],
        "order_id bigint, customer string, amount double, country string",
    )
    summary, group, measure = suggest_summary(df)
    assert (group, measure) == ("customer", "amount")
    assert [(r.customer, r.records, float(r.total_amount)) for r in summary.collect()] == [
        ("acme", 2, 165.75), ("globex", 1, 80.0),
    ]
    counted, _, nothing = suggest_summary(df.select("customer", "order_id"))
    assert nothing is None and [(r.customer, r.records) for r in counted.collect()] == [("acme", 2), ("globex", 1)]
    assert preview(df, 2).count() == 2
    assert [r.order_id for r in last_rows(df, ["order_id"], 2).collect()] == [2, 3]
    top = top_per_group(df, ["country"], "amount", 1, ["order_id"])
    assert sorted(r.order_id for r in top.collect()) == [1, 2]
    share = share_of_total(df, ["country"], "amount", "total", "pct")
    assert {r.country: float(r.pct) for r in share.collect()} == {"TH": 67.4, "SG": 32.6}


def test_models_of_one_name_are_refused():
    with pytest.raises(M.ModelError, match="several models"):
        M.build_order([M.Model("a", "SELECT 1"), M.Model("A", "SELECT 2")])


def test_templates_are_cut_at_their_marks():
    model = M.Model("m", "SELECT {{ var('d', coalesce(1, 2)) }}, {{ what }} {% raw %}{{ this }}{% if is_incremental() %} X{% endif %};")
    assert M.compile_model(model) == "SELECT coalesce(1, 2), {{ what }} {% raw %}`analytics`.`m`"
    assert M.compile_model(model, variables={"d": dt.date(2026, 1, 2)}, incremental=True).endswith("`m` X")
    assert M.literal(dt.date(2026, 1, 2)) == "DATE '2026-01-02'" and M.literal(1.5) == "1.5"
    with pytest.raises(M.ModelError, match="no end"):
        M.parts_of("{% if is_incremental() %} X")
