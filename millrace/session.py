"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Needed for the same answers everywhere: timestamps are UTC instants, and the
#: TIME type is off by default.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the results depend on; leave all tuning to the cluster."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be invisible to the other executors.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_CONSTANTS: dict[tuple[str, str, str], DataFrame] = {}


def values_table(spark: SparkSession, rows_sql: str, columns: str) -> DataFrame:
    """A small constant table as a local relation, so its size is known when planning.

    ``columns`` is a list of ``name TYPE`` parted by semicolons; each value is
    cast to its declared type.  The analysed plan is kept for the session.
    """
    key = (spark.sparkContext.applicationId, rows_sql, columns)
    if key not in _CONSTANTS:
        pairs = [c.strip().split(" ", 1) for c in columns.split(";")]
        names = ", ".join(name for name, _ in pairs)
        casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in pairs)
        _CONSTANTS[key] = spark.sql(f"SELECT {casts} FROM VALUES {rows_sql} AS v({names})")
    return _CONSTANTS[key]
