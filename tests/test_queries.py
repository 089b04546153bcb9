"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from millrace.operators.summaries import share_of_total
from millrace.session import apply_settings

from .oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# Nobody is over a limit in the smallest tables.
MAY_BE_EMPTY = {"quota_refused"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note = compare(apply_settings(spark), con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert good or (name in MAY_BE_EMPTY and note == "0 rows"), note


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_date", "country", "orders", "units", "revenue"] and df.count() > 0


def test_shares_run_the_joins_below_them_once(spark):
    """The grand total reads the groups' shuffle again, not the tables."""
    shares = share_of_total(spark.range(1000).selectExpr("id % 7 AS g", "id AS v"), ["g"], "v", "total", "share")
    shares.collect()
    final = shares._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Range (") == 1 and "ReusedExchange" in final


def test_sizes_beyond_a_bigint(spark, tmp_path):
    """With millions of customers a size is larger than 2^63."""
    made = [(1, 5_400_000, 450_000.5), (2, -3, 47.0), (3, 2_000_000_000, 500_000.0), (4, 12, 55.9)]
    orders = spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_totalprice double")
    orders.write.parquet(f"file:{tmp_path}/orders.parquet")
    found = [tuple(r) for r in QUERIES["human_text"](spark, f"file:{tmp_path}").orderBy("o_orderkey").collect()]
    assert found == [
        (1, "3h 07m", "11934389.5TB"), (2, "1.0s", "423B"), (3, "3h 28m", "1818989403545.9TB"), (4, "1.0s", "7.7KB"),
    ]
