import pytest
from pyspark.sql import SparkSession

from millrace.plans.tables import Lakehouse
from millrace.session import apply_settings


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("millrace-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "scratch"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A few rows per test: compiling code for them takes longer than running it.
        # ``python -m tests.oracle`` runs the queries with code generation.
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield apply_settings(session)
    session.stop()


@pytest.fixture
def lake(spark, tmp_path):
    """A lakehouse in a folder of its own; its namespaces go at the end."""
    made = Lakehouse(spark, f"file:{tmp_path}/lake")
    before = set(made.namespaces())
    yield made
    for name in set(made.namespaces()) - before:
        made.drop_namespace(name, cascade=True)


def rows(df):
    """All rows as tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
