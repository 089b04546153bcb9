"""SQL models: templates, build order, materialisation, data tests."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import singledispatch
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.identifiers import slug
from millrace.operators.quality import test_report as report_tests
from millrace.plans.tables import Lakehouse
from millrace.schema import TableSpec, quoted

TABLE, VIEW, INCREMENTAL, EPHEMERAL = "table", "view", "incremental", "ephemeral"

# The template marks, ``{{ call }}`` and ``{% tag %}``.
_MARK = re.compile(r"\{\{(?P<call>.*?)\}\}|\{%-?(?P<tag>.*?)-?%\}", re.S)
_CALL = re.compile(r"\s*(?P<name>\w+)\s*(?:\((?P<given>.*)\))?\s*", re.S)
_ARITY = {"this": 0, "ref": 1, "var": 1, "source": 2}


class ModelError(ValueError):
    """A model that cannot be compiled or ordered, with the reason."""


@dataclass(frozen=True)
class Model:
    """One SQL transformation and how its result is kept."""

    name: str
    sql: str
    materialization: str = TABLE
    namespace: str = "analytics"
    unique_key: tuple[str, ...] = ()
    #: Which columns say which of two records of a key is newer.
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    tests: tuple[Mapping[str, Any], ...] = ()
    description: str = ""

    def __post_init__(self) -> None:
        if not self.name or not self.sql.strip():
            raise ModelError("a model needs a name and SQL")
        if self.materialization not in (TABLE, VIEW, INCREMENTAL, EPHEMERAL):
            raise ModelError(f"unknown materialization: {self.materialization}")
        object.__setattr__(self, "name", slug(self.name))

    @property
    def table(self) -> str:
        return f"{self.namespace}.{self.name}"


@dataclass(frozen=True)
class Part:
    """A stretch of a template: plain SQL (``kind`` is "sql") or one call with its arguments."""

    kind: str
    text: str
    given: tuple[str, ...] = ()
    #: Stands inside an ``is_incremental()`` block.
    guarded: bool = False

    @property
    def names(self) -> list[str]:
        return [g.strip("'\"") for g in self.given]


def parts_of(sql: str) -> list[Part]:
    """A template cut at its marks.  Marks that mean nothing here stay as they are."""
    parts: list[Part] = []
    guarded, at = False, 0
    for mark in _MARK.finditer(sql):
        parts.append(Part("sql", sql[at : mark.start()], guarded=guarded))
        at = mark.end()
        if mark["tag"] is not None:
            tag = " ".join(mark["tag"].lower().split())
            if tag == ("endif" if guarded else "if is_incremental()"):
                guarded = not guarded
            else:
                parts.append(Part("sql", mark[0], guarded=guarded))
            continue
        call = _CALL.fullmatch(mark["call"])
        given = tuple(_split(call["given"] or "")) if call else ()
        known = call is not None and call["name"] in _ARITY and len(given) >= _ARITY[call["name"]]
        parts.append(Part(call["name"] if known else "sql", mark[0], given, guarded))
    if guarded:
        raise ModelError("an is_incremental() block has no end")
    return [*parts, Part("sql", sql[at:])]


def _split(given: str) -> list[str]:
    """Arguments as written; a comma inside quotes or brackets does not part them."""
    pieces, quote, depth = [""], "", 0
    for char in given:
        if quote:
            quote = "" if char == quote else quote
        elif char in "'\"":
            quote = char
        else:
            depth += (char in "([") - (char in ")]")
            if char == "," and not depth:
                pieces.append("")
                continue
        pieces[-1] += char
    return [p.strip() for p in pieces if p.strip()]


def parents(model: Model) -> list[str]:
    """Models this one reads: referenced or declared, by their table names."""
    read = [p.names[0] for p in parts_of(model.sql) if p.kind == "ref"]
    return list(dict.fromkeys(map(slug, read + list(model.depends_on))))


def sources_of(model: Model) -> list[tuple[str, str]]:
    return list(dict.fromkeys(tuple(p.names[:2]) for p in parts_of(model.sql) if p.kind == "source"))


@singledispatch
def literal(value: Any) -> str:
    """A value as SQL text, for statements that take no parameters, such as views."""
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


literal.register(type(None), lambda value: "NULL")
literal.register(bool, lambda value: str(value).upper())
literal.register(int, str)
literal.register(float, str)
literal.register(Decimal, lambda value: f"{value:f}BD")
literal.register(date, lambda value: f"DATE '{value.isoformat()}'")
literal.register(datetime, lambda value: f"TIMESTAMP '{value.isoformat(sep=' ')}'")


def compile_model(
    model: Model,
    models: Mapping[str, Model] | None = None,
    variables: Mapping[str, Any] | None = None,
    incremental: bool = False,
) -> str:
    """Executable SQL.

    ``ref`` becomes a table name, or the whole query of an ephemeral model;
    ``is_incremental()`` blocks stay only for an incremental build.
    """
    upstream, values = models or {}, variables or {}

    def table(name: str) -> str:
        other = upstream.get(name)
        if other and other.materialization == EPHEMERAL:
            return f"({compile_model(other, upstream, values, incremental)})"
        return quoted(other.namespace if other else model.namespace, name)

    def value(name: str, default: Sequence[str]) -> str:
        if name not in values and not default:
            raise ModelError(f"model {model.name} needs variable {name}")
        return literal(values[name]) if name in values else default[0]

    render = {
        "sql": lambda p: p.text,
        "this": lambda p: quoted(model.namespace, model.name),
        "ref": lambda p: table(slug(p.names[0])),
        "source": lambda p: quoted(*p.names[:2]),
        "var": lambda p: value(p.names[0], p.given[1:]),
    }
    kept = (p for p in parts_of(model.sql) if incremental or not p.guarded)
    return "".join(render[p.kind](p) for p in kept).strip().rstrip(";")


def by_name(models: Sequence[Model]) -> dict[str, Model]:
    """Models by their table names, which have to differ."""
    found = {m.name: m for m in models}
    if len(found) < len(models):
        several = sorted(n for n, k in Counter(m.name for m in models).items() if k > 1)
        raise ModelError(f"several models have the names {several}")
    return found


def _graph(models: Mapping[str, Model]) -> dict[str, list[str]]:
    return {n: sorted(p for p in parents(m) if p in models) for n, m in sorted(models.items())}


def build_order(models: Sequence[Model], select: Sequence[str] | None = None) -> list[str]:
    """Parents before children, by name where there is a choice.

    Selecting a model selects everything it reads.
    """
    known = by_name(models)
    graph = _graph(known)
    wanted = set(known)
    if select:
        queue = [slug(s) for s in select]
        unknown = [n for n in queue if n not in known]
        if unknown:
            raise ModelError(f"unknown models {unknown}; there are {sorted(known)}")
        wanted = set()
        while queue:
            name = queue.pop()
            if name not in wanted:
                wanted.add(name)
                queue.extend(graph[name])
    sorter = TopologicalSorter({n: [p for p in graph[n] if p in wanted] for n in sorted(wanted)})
    try:
        sorter.prepare()
    except CycleError as problem:
        raise ModelError(f"models read each other: {problem.args[1]}") from problem
    order: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    return order


def lineage(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    """Edges from sources to models and from models to models."""
    known = by_name(models)
    edges = []
    for m in models:
        edges += [(f"{ns}.{t}", m.table, "source") for ns, t in sources_of(m)]
        edges += [(known[p].table, m.table, "model") for p in parents(m) if p in known]
    return spark.createDataFrame(edges, "from_table string, to_table string, kind string")


def run_sql(
    spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, limit: int | None = None
) -> DataFrame:
    """Any Spark SQL, with named parameters for values and an optional row limit."""
    df = spark.sql(sql, args=dict(args)) if args else spark.sql(sql)
    return df if limit is None else df.limit(limit)


# --------------------------------------------------------------- materialising


@dataclass(frozen=True)
class BuildResult:
    model: str
    table: str
    materialization: str
    status: str
    rows: int | None = None
    error: str | None = None
    seconds: float = 0.0
    failures: tuple[str, ...] = ()


RESULT_SCHEMA = (
    "model string, table_name string, materialization string, status string, rows bigint, "
    "error string, seconds double, failures array<string>"
)


def materialize(lake: Lakehouse, model: Model, sql: str, incremental: bool = False) -> int | None:
    """Store the result; gives the rows written, or nothing for a view.

    An incremental build merges by key, or appends without one; new columns are
    added to the table first.
    """
    if model.materialization == VIEW:
        lake.create_namespace(model.namespace)
        lake.spark.sql(f"CREATE OR REPLACE VIEW {quoted(model.namespace, model.name)} AS {sql}")
        return None
    df = lake.spark.sql(sql)
    spec = TableSpec(_storable(df.schema), model.unique_key, model.partition_by)
    if incremental:
        lake.ensure(model.table, spec)
        if model.unique_key:
            return lake.upsert(model.table, df, model.unique_key, model.order_by).rows
        return lake.append(model.table, df).rows
    if lake.exists(model.table) and lake.spec(model.table) != spec:
        # Another shape: a rebuilt table has exactly the columns of its query.
        return lake.replace(model.table, spec, df)
    lake.ensure(model.table, spec)
    return lake.overwrite(model.table, df).rows


def _storable(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType)
            for f in schema.fields
        ]
    )


def run_tests(lake: Lakehouse, model: Model) -> list[str]:
    """What the model's tests found, one line per failing test."""
    if not model.tests or model.materialization == EPHEMERAL:
        return []
    found = []
    try:
        report = report_tests(lake.read(model.table), model.tests).filter("NOT passed")
        for row in report.collect():  # one row per declared test
            name = f"{row['test']}({row['column']})" if row["column"] else row["test"]
            found.append(f"{name}: {row['bad_rows']}")
    except Exception as problem:  # noqa: BLE001 - a test that cannot run has failed
        found.append(f"tests errored: {problem}"[:500])
    return sorted(found)


def build(
    lake: Lakehouse, model: Model, models: Mapping[str, Model], variables: Mapping[str, Any],
    full_refresh: bool, dry_run: bool,
) -> BuildResult:
    started = time.monotonic()

    def result(status: str, **more: Any) -> BuildResult:
        return BuildResult(
            model.name, model.table, model.materialization, status,
            seconds=time.monotonic() - started, **more,
        )

    try:
        incremental = (
            model.materialization == INCREMENTAL and not full_refresh and lake.exists(model.table)
        )
        sql = compile_model(model, models, variables, incremental)
        if dry_run:
            return result("compiled")
        if model.materialization == EPHEMERAL:
            return result("succeeded")
        rows = materialize(lake, model, sql, incremental)
        failures = run_tests(lake, model)
        if failures:
            return result(
                "failed", rows=rows, failures=tuple(failures), error=f"{len(failures)} tests failed"
            )
        return result("succeeded", rows=rows)
    except Exception as problem:  # noqa: BLE001 - one model must not stop the run
        return result("failed", error=f"{type(problem).__name__}: {problem}"[:2000])


def run_models(
    lake: Lakehouse,
    models: Sequence[Model],
    select: Sequence[str] | None = None,
    full_refresh: bool = False,
    dry_run: bool = False,
    variables: Mapping[str, Any] | None = None,
    unavailable: Sequence[str] = (),
    parallel: int = 1,
) -> DataFrame:
    """Build models in order; returns one result row each.

    Models whose parents are done are submitted together, up to ``parallel`` at
    once, so independent models share the cluster.  What reads a failed model,
    or a source table in ``unavailable``, is skipped.
    """
    known = by_name(models)
    order = build_order(models, select)
    graph = _graph(known)
    results: dict[str, BuildResult] = {}
    sorter = TopologicalSorter({n: [p for p in graph[n] if p in order] for n in order})
    sorter.prepare()
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        running: dict[Future[BuildResult], str] = {}
        while sorter.is_active():
            for name in sorted(sorter.get_ready()):
                model = known[name]
                blocked = [p for p in graph[name] if results[p].status in ("failed", "skipped")]
                blocked += [f"{n}.{t}" for n, t in sources_of(model) if f"{n}.{t}" in unavailable]
                if blocked:
                    results[name] = BuildResult(
                        name, model.table, model.materialization, "skipped",
                        error=f"needs {', '.join(blocked)}",
                    )
                    sorter.done(name)
                else:
                    job = pool.submit(
                        build, lake, model, known, variables or {}, full_refresh, dry_run
                    )
                    running[job] = name
            if running:
                finished, _ = wait(running, return_when=FIRST_COMPLETED)
                for job in finished:
                    name = running.pop(job)
                    results[name] = job.result()
                    sorter.done(name)
    rows = [
        (r.model, r.table, r.materialization, r.status, r.rows, r.error, r.seconds, list(r.failures))
        for r in (results[n] for n in order)
    ]
    return lake.spark.createDataFrame(rows, RESULT_SCHEMA)


run_tests.__test__ = False  # not a pytest case
