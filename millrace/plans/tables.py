"""Tables in the Spark catalog: create, evolve, write, merge, compact, measure.

A table is Parquet files under a location of its own.  A rewrite goes to a new
version folder and then the catalog entry is pointed at it in one step, so a
reader sees the old or the new rows and a job that dies leaves the old ones in
place.  A partitioned table is rewritten partition by partition instead: only
partitions that hold an incoming key are staged and replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.operators.conform import BAD_CELLS, conform
from millrace.operators.merge import cursor_text, merge_frames
from millrace.operators.partitioning import laid_out, with_partitions
from millrace.schema import TableSpec, quoted

SPEC_PROPERTY = "millrace.spec"
STAGING_PREFIX = "_stage_"
REJECTS_SUFFIX = "_rejects"
CODEC = "zstd"


@dataclass(frozen=True)
class Written:
    """What one write did."""

    table: str
    rows: int
    bytes_moved: int
    schema_changed: bool = False
    cursor: object = None
    rejected: int = 0


@dataclass(frozen=True)
class _Aside:
    """Rows with bad cells, staged beside the good ones."""

    folder: str
    rows: DataFrame
    count: int


class Lakehouse:
    """Namespaces and tables of one session, stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")

    # ------------------------------------------------------------- namespaces

    def create_namespace(self, namespace: str) -> None:
        home = f"{self.root}/{namespace}.db"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(namespace)} LOCATION '{home}'")

    def namespaces(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def drop_namespace(self, namespace: str, cascade: bool = False) -> None:
        """Refuses a namespace with tables unless told to drop them too."""
        word = "CASCADE" if cascade else "RESTRICT"
        self.spark.sql(f"DROP DATABASE IF EXISTS {quoted(namespace)} {word}")

    # ----------------------------------------------------------------- tables

    def _parts(self, table: str) -> tuple[str, str]:
        namespace, name = S.table_name(table)
        return namespace or self.spark.catalog.currentDatabase(), name

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(".".join(quoted(p) for p in self._parts(table)))

    def read(self, table: str, derived: bool = False) -> DataFrame:
        """The rows of a table: its declared columns.

        With ``derived`` the derived partition columns too, for filters that prune partitions.
        """
        df = self.spark.table(quoted(*self._parts(table)))
        spec = self._stored_spec(table)
        if spec is None or derived:
            return df
        return df.drop(*[c for c in self._partition_columns(table) if S.find(spec.schema, c) is None])

    def tables(self, namespace: str, staging: bool = False) -> list[str]:
        names = [
            t.name
            for t in self.spark.catalog.listTables(namespace)
            if not t.isTemporary and (staging or not t.name.startswith(STAGING_PREFIX))
        ]
        return sorted(names)

    def _new_location(self, table: str) -> str:
        namespace, name = self._parts(table)
        return f"{self.root}/{namespace}.db/{name}/v-{uuid.uuid4().hex}"

    def create(self, table: str, spec: TableSpec, location: str | None = None) -> None:
        """An empty table; partition expressions become derived columns."""
        S.checked(spec.schema)
        empty = self.spark.createDataFrame([], spec.schema)
        widened, names = with_partitions(empty, list(spec.partition_by))
        columns = [f for f in widened.schema.fields if f.name not in names]
        columns += [widened.schema[n] for n in names]
        by = f"PARTITIONED BY ({', '.join(quoted(n) for n in names)})" if names else ""
        stored = json.dumps(spec.to_dict()).replace("\\", "\\\\").replace("'", "\\'")
        namespace, name = self._parts(table)
        self.create_namespace(namespace)
        # Columns stay nullable in storage, as every write mode may add NULLs later.
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in columns])
        home = location or self._new_location(table)
        self._filesystem(home).mkdirs(self._path(home))
        self.spark.sql(
            f"CREATE TABLE {quoted(namespace, name)} ({S.ddl(nullable)}) USING parquet {by} "
            f"LOCATION '{home}' "
            f"TBLPROPERTIES ('{SPEC_PROPERTY}' = '{stored}', 'parquet.compression' = '{CODEC}')"
        )

    def ensure(self, table: str, spec: TableSpec) -> bool:
        """Create the table or add the columns it lacks; tells whether it changed."""
        if not self.exists(table):
            self.create(table, spec)
            return True
        return self.evolve(table, spec.schema)

    def drop(self, table: str) -> None:
        """Remove the table and its files."""
        namespace, name = self._parts(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(namespace, name)}")
        self._delete(f"{self.root}/{namespace}.db/{name}")

    def _properties(self, table: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {quoted(*self._parts(table))}").collect()
        return {r["key"]: r["value"] for r in rows}

    def _stored_spec(self, table: str) -> TableSpec | None:
        text = self._properties(table).get(SPEC_PROPERTY)
        return TableSpec.from_dict(json.loads(text)) if text else None

    def spec(self, table: str) -> TableSpec:
        stored = self._stored_spec(table)
        if stored is not None:
            return stored
        return TableSpec(schema=self.spark.table(quoted(*self._parts(table))).schema)

    def _save_spec(self, table: str, spec: TableSpec) -> None:
        stored = json.dumps(spec.to_dict()).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"ALTER TABLE {quoted(*self._parts(table))} "
            f"SET TBLPROPERTIES ('{SPEC_PROPERTY}' = '{stored}')"
        )

    def evolve(self, table: str, incoming: T.StructType) -> bool:
        """Add columns the table lacks, as nullable; nothing is dropped or narrowed."""
        spec = self.spec(table)
        added = S.added_columns(spec.schema, incoming)
        if not added:
            return False
        name = quoted(*self._parts(table))
        self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({S.ddl(T.StructType(added))})")
        grown = T.StructType(spec.schema.fields + added)
        self._save_spec(table, TableSpec(grown, spec.keys, spec.partition_by, spec.sort_by, spec.doc))
        return True

    def _partition_columns(self, table: str) -> list[str]:
        columns = self.spark.catalog.listColumns(quoted(*self._parts(table)))
        return [c.name for c in columns if c.isPartition]

    # ----------------------------------------------------------------- writes

    def _watched(
        self, df: DataFrame, watch: Sequence[str], cursor: str | None
    ) -> tuple[DataFrame, Observation]:
        """Counts rows and JSON bytes while they pass, so no second scan is needed."""
        seen = Observation(f"write-{uuid.uuid4().hex}")
        measures = [
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in watch])))), F.lit(0)).alias("bytes"),
        ]
        if cursor:
            newest = F.max(F.col(f"`{cursor}`"))
            measures.append(cursor_text(newest, df.schema[cursor].dataType).alias("cursor"))
        return df.observe(seen, *measures), seen

    def _prepared(
        self, df: DataFrame, table: str, on_error: str
    ) -> tuple[DataFrame, list[str], TableSpec]:
        """Conformed rows with their partition columns, the columns' names, the table's spec."""
        spec = self.spec(table)
        ready = conform(df, spec.schema, on_error)
        return *with_partitions(ready, list(spec.partition_by)), spec

    def _insert(
        self, df: DataFrame, table: str, spec: TableSpec, names: list[str], overwrite: bool
    ) -> None:
        """Append, or replace exactly the partitions that ``df`` has rows for."""
        name = quoted(*self._parts(table))
        arranged = laid_out(df, names, list(spec.sort_by))
        self._write_into(arranged, name, overwrite)

    def _write_into(self, df: DataFrame, name: str, overwrite: bool) -> None:
        columns = ", ".join(quoted(c) for c in self.spark.table(name).columns)
        verb = "OVERWRITE" if overwrite else "INTO"
        # The mode is set for this statement alone, not for the session.
        self.spark.sql(
            f"INSERT {verb} {name} WITH ('partitionOverwriteMode' = 'dynamic', "
            f"'compression' = '{CODEC}') SELECT {columns} FROM {{rows}}",
            rows=df,
        )

    def _publish(self, df: DataFrame, table: str, spec: TableSpec) -> None:
        """Write a new version of an unpartitioned table and point the catalog at it."""
        location = self._new_location(table)
        name = quoted(*self._parts(table))
        arranged = laid_out(df, [], list(spec.sort_by)).select(
            *[F.col(f"`{c}`") for c in self.spark.table(name).columns]
        )
        arranged.write.mode("overwrite").option("compression", CODEC).parquet(location)
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        self.spark.catalog.refreshTable(name)

    def _written(self, table: str, seen: Observation, changed: bool, aside: _Aside | None = None) -> Written:
        """Ends a write: the rows set aside go to the table of rejects, after the good ones."""
        values = seen.get
        if aside is not None and aside.count:
            rejects = self.rejects(table)
            self.ensure(rejects, TableSpec(aside.rows.schema))
            self.append(rejects, aside.rows)
        return Written(
            table, int(values["rows"]), int(values["bytes"]), changed, values.get("cursor"), aside.count if aside else 0
        )

    def rejects(self, table: str) -> str:
        """The table that takes rows with cells which ``table`` can't hold."""
        namespace, name = self._parts(table)
        return f"{namespace}.{name}{REJECTS_SUFFIX}"

    def _sorted_out(self, df: DataFrame, table: str, on_error: str) -> tuple[DataFrame, str, _Aside | None]:
        """The rows to write, how to write them, and the rows to set aside.

        With ``quarantine`` the source is read once: one job writes good and bad
        rows to two folders of a stage and counts the bad ones on the way.  A bad
        row keeps its good cells, and lists the others as JSON in ``_bad_cells``.
        """
        if on_error != "quarantine":
            return df, on_error, None
        schema = self.spec(table).schema
        listed = conform(df, schema, on_error)
        seen = Observation(f"aside-{uuid.uuid4().hex}")
        bad = F.size(BAD_CELLS) > 0
        rows = listed.withColumn("_aside", bad).withColumn(BAD_CELLS, F.when(bad, F.to_json(BAD_CELLS)))
        folder = f"{self._new_location(table)}-aside"
        watched = rows.observe(seen, F.count_if("_aside").alias("rejected"))
        watched.write.partitionBy("_aside").option("compression", CODEC).parquet(folder)
        staged = self.spark.read.schema(rows.schema).parquet(folder)
        good = staged.where(~F.col("_aside")).drop("_aside", BAD_CELLS)
        bad_rows = staged.where("_aside").drop("_aside")
        return good, "fail", _Aside(folder, bad_rows, int(seen.get["rejected"]))

    def _forget(self, aside: _Aside | None) -> None:
        if aside is not None:
            self._delete(aside.folder)

    def append(
        self, table: str, df: DataFrame, on_error: str = "fail", cursor: str | None = None,
        schema_changed: bool = False,
    ) -> Written:
        df, on_error, aside = self._sorted_out(df, table, on_error)
        try:
            ready, names, spec = self._prepared(df, table, on_error)
            watched, seen = self._watched(ready, spec.schema.names, cursor)
            self._insert(watched, table, spec, names, overwrite=False)
            return self._written(table, seen, schema_changed, aside)
        finally:
            self._forget(aside)

    def overwrite(
        self, table: str, df: DataFrame, on_error: str = "fail", cursor: str | None = None,
        schema_changed: bool = False,
    ) -> Written:
        """Replace all rows, also by none."""
        df, on_error, aside = self._sorted_out(df, table, on_error)
        try:
            ready, names, spec = self._prepared(df, table, on_error)
            watched, seen = self._watched(ready, spec.schema.names, cursor)
            if names:
                self._swap(table, spec, watched, names)
            else:
                self._publish(watched, table, spec)
            return self._written(table, seen, schema_changed, aside)
        finally:
            self._forget(aside)

    def upsert(
        self,
        table: str,
        df: DataFrame,
        keys: Sequence[str],
        order_by: Sequence[str] = (),
        null_safe: bool = True,
        on_error: str = "fail",
        cursor: str | None = None,
        schema_changed: bool = False,
    ) -> Written:
        """Keyed write: the newest record per key replaces the row with that key.

        The batch is staged once under the scratch of the table, because the
        merge reads it twice and its source may not give the same rows again.
        """
        if not keys:
            return self.append(table, df, on_error, cursor, schema_changed)
        df, on_error, aside = self._sorted_out(df, table, on_error)
        ready, names, spec = self._prepared(df, table, on_error)
        watched, seen = self._watched(ready, spec.schema.names, cursor)
        stage = f"{self._new_location(table)}-stage"
        try:
            watched.write.mode("overwrite").option("compression", CODEC).parquet(stage)
            batch = self.spark.read.schema(watched.schema).parquet(stage)
            target = self.spark.table(quoted(*self._parts(table)))
            if not names:
                self._publish(merge_frames(target, batch, keys, order_by, null_safe), table, spec)
            else:
                self._upsert_partitions(
                    table, spec, target, batch, keys, order_by, null_safe, names, f"{stage}/_touched"
                )
            return self._written(table, seen, schema_changed, aside)
        finally:
            self._delete(stage)
            self._forget(aside)

    def _upsert_partitions(
        self,
        table: str,
        spec: TableSpec,
        target: DataFrame,
        batch: DataFrame,
        keys: Sequence[str],
        order_by: Sequence[str],
        null_safe: bool,
        names: list[str],
        stage: str,
    ) -> None:
        """Merge and replace only partitions that hold an incoming key, old or new.

        Which these are is a frame like any other, written beside the staged
        batch: one row per partition with the rows that leave it, stay and enter.
        The target joins it by partition, so partitions that nothing touches are
        pruned while the job runs.
        """
        sign = "<=>" if null_safe else "="
        key_match = F.expr(" AND ".join(f"`{k}` {sign} `_in_{k}`" for k in keys))
        incoming = batch.select(*[F.col(f"`{k}`").alias(f"_in_{k}") for k in keys]).distinct()
        part = [F.col(f"`{n}`") for n in names]
        met = target.join(incoming.withColumn("_met", F.lit(1)), key_match, "left")
        held = met.groupBy(*part).agg(F.count("_met").alias("_leave"), F.count_if(F.isnull("_met")).alias("_stay"))
        entered = batch.groupBy(*part).agg(F.count(F.lit(1)).alias("_enter"))
        counted = held.unionByName(entered, allowMissingColumns=True).groupBy(*part).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_leave", "_stay", "_enter")]
        )
        counted.where("_leave + _enter > 0").write.option("compression", CODEC).parquet(stage)
        touched = self.spark.read.schema(counted.schema).parquet(stage)
        merged = merge_frames(_of_partitions(target, touched, names), batch, keys, order_by, null_safe)
        self._insert(merged, table, spec, names, overwrite=True)
        # The overwrite replaces partitions that have rows; those that rows only left would keep the old ones.
        self._drop_partitions(table, names, touched.where("_stay + _enter = 0").select(*part))

    def _swap(self, table: str, spec: TableSpec, df: DataFrame, names: list[str]) -> None:
        """Build the table anew beside the old one, then take its place.

        The rows are complete before the old table goes; only between the two
        catalog steps is the name missing.
        """
        namespace, name = self._parts(table)
        staged = f"{namespace}.{STAGING_PREFIX}{name}"
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(*self._parts(staged))}")
        self.create(staged, spec, location=self._new_location(table))
        self._insert(df, staged, spec, names, overwrite=False)
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(namespace, name)}")
        self.spark.sql(
            f"ALTER TABLE {quoted(*self._parts(staged))} RENAME TO {quoted(namespace, name)}"
        )

    def replace(self, table: str, spec: TableSpec, df: DataFrame) -> int:
        """A table with exactly these columns and rows in place of the old one, if any."""
        widened, names = with_partitions(conform(df, spec.schema), list(spec.partition_by))
        watched, seen = self._watched(widened, spec.schema.names, None)
        self._swap(table, spec, watched, names)
        return int(seen.get["rows"])

    def _drop_partitions(self, table: str, names: list[str], emptied: DataFrame) -> None:
        """Remove partitions with their files; a catalog step each, fetched a part at a time."""
        name = quoted(*self._parts(table))
        for one in emptied.toLocalIterator():
            spec = ", ".join(f"{quoted(n)} = {_literal(v)}" for n, v in zip(names, one))
            where = self.spark.sql(f"DESCRIBE FORMATTED {name} PARTITION ({spec})").collect()
            folder = next(r["data_type"] for r in where if r["col_name"] == "Location")
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
            self._delete(folder)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _filesystem(self, path: str):
        """The Hadoop file system of a path: tables may live on any of them."""
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._filesystem(path).delete(self._path(path), True)

    # ------------------------------------------------------------ maintenance

    def files(self, table: str) -> DataFrame:
        """``path, uri, length`` of every data file, listed by Spark, contents unread."""
        return self._listed([self.location(table)])

    def _listed(self, folders: list[str]) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return found.option("pathGlobFilter", "*.parquet").load(folders).select(
            "path", F.col("_metadata.file_path").alias("uri"), "length"
        )

    def location(self, table: str) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {quoted(*self._parts(table))}").collect()
        return next(r["data_type"] for r in rows if r["col_name"] == "Location")

    def compact(self, table: str, target_bytes: int = 128_000_000) -> bool:
        """Rewrite small files into files of about ``target_bytes``; rows stay the same.

        An unpartitioned table is rewritten as a new version.  A partitioned one
        is rewritten in one job, and only where a partition has two or more
        small files; a large partition is spread over as many tasks as it needs.
        """
        names = self._partition_columns(table)
        name = quoted(*self._parts(table))
        folder = F.regexp_replace("uri", "/[^/]+$", "").alias("folder")
        crowded = (
            self.files(table)
            .groupBy(folder)
            .agg(
                F.count_if(F.col("length") < target_bytes).alias("small"),
                F.ceil(F.sum("length") / F.lit(target_bytes)).cast("int").alias("parts"),
                F.min(F.regexp_replace("path", "/[^/]+$", "")).alias("path"),
            )
            .filter(F.col("small") > 1)
        )
        # One row per folder: the list is as long as the list of partitions.
        todo = crowded.collect()
        if not todo:
            return False
        total = sum(r["parts"] for r in todo)
        if not names:
            self._publish(self.spark.table(name).repartition(total), table, self.spec(table))
            return True
        columns = [F.col(f"`{c}`") for c in self.spark.table(name).columns]
        wanted = crowded.select(F.col("folder").alias("_folder"), "parts")
        rows = (
            self.spark.read.schema(self.spark.table(name).schema)
            .option("basePath", self.location(table))
            .parquet(*[r["path"] for r in todo])
        )
        placed = rows.select(
            *columns,
            F.regexp_replace("_metadata.file_path", "/[^/]+$", "").alias("_in"),
            F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"),
        ).join(wanted, F.col("_in") == F.col("_folder"))
        salt = F.pmod(F.col("_row"), F.col("parts"))
        spread = placed.repartition(total, F.col("_folder"), salt).select(*columns)
        order = [*names, *self.spec(table).sort_by]
        # The new files are complete before the old partitions are replaced.
        self._write_into(
            spread.sortWithinPartitions(*[F.col(f"`{c}`") for c in order]), name, overwrite=True
        )
        return True

    def drop_old_versions(self, table: str) -> int:
        """Delete version folders the catalog no longer points at; returns how many."""
        current = self.location(table).rstrip("/").rsplit("/", 1)[-1]
        namespace, name = self._parts(table)
        home = f"{self.root}/{namespace}.db/{name}"
        system = self._filesystem(home)
        old = [
            s.getPath() for s in system.listStatus(self._path(home)) if s.getPath().getName() != current
        ]
        for path in old:
            system.delete(path, True)
        return len(old)

    def stats(self, namespace: str) -> DataFrame:
        """``table_name, row_count, size_bytes, columns`` of every table of a namespace.

        Two scans for all tables together: one without columns, whose rows come
        from the footers, and a listing of the files' lengths.  A file belongs to
        the table whose folder is above it.
        """
        known = [(n, f"{namespace}.{n}") for n in self.tables(namespace) if not self._is_view(f"{namespace}.{n}")]
        facts = [(name, self.location(table), len(self.read(table).columns)) for name, table in known]
        listed = self.spark.createDataFrame(facts, "table_name string, location string, columns int")
        homes = listed.select("table_name", _plain_path(F.col("location")).alias("_home"), "columns")
        if not facts:
            return homes.selectExpr("table_name", "0L AS row_count", "0L AS size_bytes", "columns")
        folders = [home for _, home, _ in facts]
        footers = self.spark.read.schema(T.StructType([])).option("recursiveFileLookup", True).parquet(*folders)
        rows = footers.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
        files = rows.unionByName(
            self._listed(folders).select(F.col("uri").alias("_file"), F.col("length").alias("_size")), allowMissingColumns=True
        )
        parts = F.split(_plain_path(F.col("_file")), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        held = (
            files.select(F.explode(above).alias("_home"), "_rows", "_size")
            .join(homes, "_home")
            .groupBy("table_name")
            .agg(F.sum("_rows").alias("_rows"), F.sum("_size").alias("_size"))
        )
        counted = [F.coalesce(a, F.lit(0)).alias(b) for a, b in (("_rows", "row_count"), ("_size", "size_bytes"))]
        return homes.join(held, "table_name", "left").select("table_name", *counted, "columns")

    def _is_view(self, table: str) -> bool:
        return self.spark.catalog.getTable(".".join(quoted(p) for p in self._parts(table))).tableType == "VIEW"


def _of_partitions(target: DataFrame, touched: DataFrame, names: list[str]) -> DataFrame:
    """The target's rows in the partitions that ``touched`` lists, found while the job runs.

    Plain equality lets the scan be pruned by the other side's rows.  Partitions
    with a missing value are a scan of their own, pruned when it is planned.
    """
    wanted = touched.where("_leave + _stay > 0").select(*[F.col(f"`{n}`").alias(f"_p_{n}") for n in names])
    absent = reduce(or_, [F.isnull(F.col(f"`{n}`")) for n in names])
    absent_there = reduce(or_, [F.isnull(F.col(f"`_p_{n}`")) for n in names])
    same, same_or_null = (
        F.expr(" AND ".join(f"`{n}` {sign} `_p_{n}`" for n in names)) for sign in ("=", "<=>")
    )
    whole = target.where(~absent).join(wanted.where(~absent_there), same, "left_semi")
    return whole.unionByName(target.where(absent).join(wanted.where(absent_there), same_or_null, "left_semi"))


def _plain_path(path: Column) -> Column:
    """A path with one form of scheme and no slash at its end."""
    return F.regexp_replace(F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):/{2,}", "$1:/"), "/+$", "")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    return "'" + str(value).replace("'", "\\'") + "'"


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes of all files under a path."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))


def write_parquet(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> None:
    arranged = df.sortWithinPartitions(*sort_by) if sort_by else df
    arranged.write.mode("overwrite").option("compression", CODEC).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


__all__ = ["Lakehouse", "Written", "storage_bytes", "write_json_lines", "write_parquet"]
