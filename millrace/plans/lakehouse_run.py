"""A whole run: sync every source, build the models, compact the tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.models import Model, run_models
from millrace.plans.sync import Source, SyncSpec, sync
from millrace.plans.tables import Lakehouse

TASK_SCHEMA = "run_id string, kind string, task string, status string, records bigint, error string"


def run_lakehouse(
    spark: SparkSession,
    sources: Mapping[str, tuple[Source, Sequence[SyncSpec]]],
    models: Sequence[Model] = (),
    lake: Lakehouse | None = None,
    namespace: str = "raw",
    select: Sequence[str] | None = None,
    full_refresh: bool = False,
    skip_ingest: bool = False,
    skip_transform: bool = False,
    compact_below: int | None = None,
    variables: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The task log of the run; ``plans.sync.run_rollup`` sums it up.

    Models that read a table whose sync failed are skipped.  Compaction is best
    effort: a table it fails on keeps its files.
    """
    lake = lake or Lakehouse(spark)
    run = uuid.uuid4().hex
    tasks: list[tuple] = []
    unavailable: list[str] = []
    touched: set[str] = set()
    if not skip_ingest:
        for name, (source, specs) in sources.items():
            for row in sync(spark, name, source, specs, namespace, lake, run_id=run).collect():
                status = "succeeded" if row["succeeded"] else "failed"
                tasks.append(
                    (run, "ingest", f"{name}.{row['stream']}", status, row["records"], row["error"])
                )
                (touched.add if row["succeeded"] else unavailable.append)(row["table_name"])
    if not skip_transform and models:
        built = run_models(
            lake, models, select, full_refresh, variables=variables, unavailable=unavailable
        )
        for row in built.collect():
            tasks.append((run, "transform", row["model"], row["status"], row["rows"], row["error"]))
            if row["status"] == "succeeded" and row["materialization"] in ("table", "incremental"):
                touched.add(row["table_name"])
    if compact_below:
        for table in sorted(touched):
            try:
                lake.compact(table, compact_below)
                tasks.append((run, "maintenance", table, "succeeded", None, None))
            except Exception as problem:  # noqa: BLE001 - best effort
                tasks.append((run, "maintenance", table, "skipped", None, str(problem)[:500]))
    return spark.createDataFrame(tasks, TASK_SCHEMA)
