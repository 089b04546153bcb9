"""Relational tables over JDBC: full, incremental and parallel reads, discovery.

Reads are DataFrames, so filters and column choice are pushed to the database.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.merge import since
from millrace.schema import kind_of

# Rows per fetch, the kinds a cursor may have, preferred names.
FETCH_ROWS = 5000
CURSOR_KINDS = {"timestamp", "timestamptz", "date", "long", "int", "decimal"}
CURSOR_NAMES = ["updated_at", "modified_at", "created_at", "id"]
DEFAULT_SCHEMA = "public"


@dataclass(frozen=True)
class Split:
    """How to read a table in parallel: ``parts`` ranges of a column."""

    column: str
    lower: object
    upper: object
    parts: int


@dataclass(frozen=True)
class Database:
    url: str
    driver: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    #: Run in every connection before reading, such as a read-only switch.
    session_init: str | None = None

    def options(self, split: Split | None = None, fetch_rows: int = FETCH_ROWS) -> dict[str, str]:
        out = {"url": self.url, "fetchsize": str(fetch_rows), **self.properties}
        if self.driver:
            out["driver"] = self.driver
        if self.session_init:
            out["sessionInitStatement"] = self.session_init
        if split:
            out.update(
                partitionColumn=split.column,
                lowerBound=str(split.lower),
                upperBound=str(split.upper),
                numPartitions=str(split.parts),
            )
        return out


def read_table(
    spark: SparkSession, database: Database, table: str, split: Split | None = None
) -> DataFrame:
    return (
        spark.read.format("jdbc").options(**database.options(split)).option("dbtable", table).load()
    )


def read_since(
    spark: SparkSession,
    database: Database,
    table: str,
    cursor: str,
    last: object | None,
    split: Split | None = None,
) -> DataFrame:
    """Rows at or after the checkpoint; the keyed write removes the replayed boundary."""
    return since(read_table(spark, database, table, split), cursor, last, inclusive=True)


def default_cursor(schema: T.StructType) -> str | None:
    """The column to read new rows by: a conventional name, else the first that fits."""
    conventional = {name: place for place, name in enumerate(CURSOR_NAMES)}
    fit = (f.name for f in schema.fields if kind_of(f) in CURSOR_KINDS)
    # ``min`` keeps the order of the columns where no name decides
    return min(fit, key=lambda n: conventional.get(n, len(conventional)), default=None)


def stream_name(namespace: str, table: str) -> str:
    """The table's name, behind that of its schema unless it is the default one."""
    return "_".join([namespace] * (namespace != DEFAULT_SCHEMA) + [table])


def discovery_query(schemas: Iterable[str]) -> str:
    """Columns of all base tables with their place in the primary key."""
    chosen = ", ".join("'" + s.replace("'", "''") + "'" for s in schemas)
    primary = """
        SELECT table_schema, table_name, column_name, used.ordinal_position AS key_position
        FROM information_schema.key_column_usage AS used
        JOIN information_schema.table_constraints AS rule USING (constraint_name, table_schema, table_name)
        WHERE rule.constraint_type = 'PRIMARY KEY'"""
    base = "SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'"
    return f"""
        SELECT table_schema, table_name, column_name, held.ordinal_position, held.data_type,
               held.is_nullable, primary_key.key_position
        FROM information_schema.columns AS held
        JOIN ({base}) AS base USING (table_schema, table_name)
        LEFT JOIN ({primary}) AS primary_key USING (table_schema, table_name, column_name)
        WHERE table_schema IN ({chosen})
    """


# Database types that may be a cursor.
CURSOR_DATABASE_TYPES = [
    "timestamp with time zone",
    "timestamp without time zone",
    "date",
    "bigint",
    "integer",
    "smallint",
    "numeric",
]


def describe_streams(columns: DataFrame) -> DataFrame:
    """One row per table from the rows of ``discovery_query``.

    ``name, namespace, columns, keys, cursor, incremental``.
    """
    column = F.struct(
        "ordinal_position", F.col("column_name").alias("name"), "data_type",
        (F.col("is_nullable") == "YES").alias("nullable"),
    )
    may_be_cursor = F.col("data_type").isin(CURSOR_DATABASE_TYPES)
    preferred = F.array_position(F.array(*[F.lit(n) for n in CURSOR_NAMES]), F.col("column_name"))
    rank = F.struct(
        F.when(preferred > 0, preferred).otherwise(F.lit(len(CURSOR_NAMES) + 1)),
        F.col("ordinal_position"),
    )
    key = F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column_name"))
    grouped = columns.groupBy("table_schema", "table_name").agg(
        F.array_sort(F.collect_list(column)).alias("columns"),
        F.array_sort(F.collect_list(key)).alias("keys"),
        F.min_by("column_name", F.when(may_be_cursor, rank)).alias("cursor"),
    )
    return grouped.select(
        F.when(F.col("table_schema") == DEFAULT_SCHEMA, F.col("table_name"))
        .otherwise(F.concat_ws("_", "table_schema", "table_name"))
        .alias("name"),
        F.col("table_schema").alias("namespace"),
        F.transform("columns", lambda c: F.struct(c["name"], c["data_type"], c["nullable"])).alias("columns"),
        F.transform("keys", lambda k: k["column_name"]).alias("keys"),
        "cursor",
        F.col("cursor").isNotNull().alias("incremental"),
    )


def discover(spark: SparkSession, database: Database, schemas: Iterable[str] = (DEFAULT_SCHEMA,)) -> DataFrame:
    reader = spark.read.format("jdbc").options(**database.options())
    return describe_streams(reader.option("query", discovery_query(schemas)).load())


def discover_catalog(spark: SparkSession, namespace: str) -> list[dict[str, object]]:
    """Tables of a Spark namespace with columns and the default cursor."""
    out = []
    for table in spark.catalog.listTables(namespace):
        if table.isTemporary:
            continue
        schema = spark.table(f"`{namespace}`.`{table.name}`").schema
        out.append(
            {
                "name": table.name,
                "columns": schema.names,
                "nullable": [f.nullable for f in schema.fields],
                "cursor": default_cursor(schema),
            }
        )
    return out
