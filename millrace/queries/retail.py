"""SQL models over the retail tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.summaries import share_of_total, suggest_summary
from millrace.plans.models import EPHEMERAL, INCREMENTAL, TABLE, VIEW, Model, compile_model, materialize
from millrace.plans.tables import Lakehouse
from millrace.queries import query
from millrace.queries.inputs import SCHEMAS, table
from millrace.session import scratch_path

#: Line grain orders and customers, as views over the test files' tables.
RAW_VIEWS = {
    "orders": """
        SELECT l_orderkey AS order_id, l_linenumber AS line, o_custkey AS customer_id,
               l_partkey AS sku, p_name AS product, p_brand AS category,
               CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
               CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, o_orderdate AS ordered_at
        FROM `{raw}`.lineitem
        JOIN `{raw}`.sales ON o_orderkey = l_orderkey
        JOIN `{raw}`.part ON p_partkey = l_partkey""",
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS name, n_name AS country
        FROM `{raw}`.customer
        LEFT JOIN `{raw}`.nation ON n_nationkey = c_nationkey""",
}

ORDER_FACTS = """
    SELECT o.order_id, o.line, o.customer_id, c.name AS customer_name, c.country, o.sku,
           o.product, o.category, o.quantity, o.amount, CAST(o.ordered_at AS DATE) AS order_date
    FROM {{ source('SPACE', 'orders') }} o
    LEFT JOIN {{ source('SPACE', 'customers') }} c ON o.customer_id = c.customer_id
"""
DAILY_REVENUE = """
    SELECT order_date, country, count(*) AS orders, sum(quantity) AS units,
           round(sum(amount), 2) AS revenue
    FROM {{ ref('order_facts') }}
    GROUP BY order_date, country
"""
# The grand total is a one-row subquery over the groups, so they never meet in one task.
CATEGORY_MIX = """
    WITH mix AS (
      SELECT category, sum(amount) AS amount FROM {{ ref('order_facts') }} GROUP BY category
    )
    SELECT category, round(amount, 2) AS revenue,
           100.0 * amount / (SELECT sum(amount) FROM mix) AS pct_of_revenue
    FROM mix
"""

SQL_FACTS = """facts AS (
    SELECT l_orderkey AS order_id, l_linenumber AS line, o_custkey AS customer_id,
           c_name AS customer_name, n_name AS country, l_partkey AS sku, p_name AS product,
           p_brand AS category, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
           CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, CAST(o_orderdate AS DATE) AS order_date
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
    LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def raw_namespace(spark: SparkSession, sf_dir: str) -> str:
    """A namespace with the raw views of one data folder."""
    name = "raw_" + re.sub("[^a-z0-9]+", "_", sf_dir.lower()).strip("_")
    home = scratch_path(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{home}'")
    if spark.catalog.tableExists(f"`{name}`.`customers`"):
        return name
    for file in ("lineitem", "orders", "part", "customer", "nation"):
        # ``orders`` is the name of the view the models read.
        table_of = "sales" if file == "orders" else file
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}`.`{table_of}` ({SCHEMAS[file]}) "
            f"USING parquet LOCATION '{sf_dir}/{file}.parquet'"
        )
    for view, sql in RAW_VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW `{name}`.`{view}` AS {sql.format(raw=name)}")
    return name


def retail_models(space: str, facts: str = EPHEMERAL) -> dict[str, Model]:
    models = [
        Model("order_facts", ORDER_FACTS.replace("SPACE", space), facts, namespace=f"{space}_built"),
        Model("daily_revenue", DAILY_REVENUE, TABLE, namespace=f"{space}_built"),
        Model("category_mix", CATEGORY_MIX, VIEW, namespace=f"{space}_built"),
    ]
    return {m.name: m for m in models}


def model_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    models = retail_models(raw_namespace(spark, sf_dir))
    return spark.sql(compile_model(models[name], models))


@query(f"WITH {SQL_FACTS} SELECT * FROM facts")
def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_frame(spark, sf_dir, "order_facts")


@query(
    f"""WITH {SQL_FACTS}
    SELECT order_date, country, count(*) AS orders, sum(quantity) AS units,
           CAST(sum(amount) AS DECIMAL(18,2)) AS revenue
    FROM facts GROUP BY order_date, country"""
)
def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = model_frame(spark, sf_dir, "daily_revenue")
    return df.withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))


@query(
    f"""WITH {SQL_FACTS}
    SELECT category, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue,
           CAST(100.0::DOUBLE * CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE)
                AS DECIMAL(9,3)) AS pct_of_revenue
    FROM facts GROUP BY category"""
)
def category_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = model_frame(spark, sf_dir, "category_mix")
    return df.select(
        "category",
        F.col("revenue").cast("decimal(18,2)").alias("revenue"),
        F.col("pct_of_revenue").cast("decimal(9,3)").alias("pct_of_revenue"),
    )


@query(
    """SELECT n_name AS country, count(*) AS orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS revenue
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY 1"""
)
def country_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = table(spark, sf_dir, "nation")
    amount = F.col("o_totalprice").cast("decimal(18,4)")
    return (
        orders.join(customers, ["c_custkey"])
        .join(nations, ["n_nationkey"])
        .groupBy(F.col("n_name").alias("country"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(amount).cast("decimal(18,2)").alias("revenue"))
    )


@query(
    """SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS revenue,
       CAST(100.0::DOUBLE * CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE)
            / CAST(sum(sum(CAST(o_totalprice AS DECIMAL(18,4)))) OVER () AS DOUBLE) AS DECIMAL(9,3)) AS share
    FROM orders GROUP BY 1"""
)
def priority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,4)"))
    out = share_of_total(orders, ["o_orderpriority"], "amount", "revenue", "share", 3)
    return out.withColumn("revenue", F.col("revenue").cast("decimal(18,4)"))


@query(
    f"""WITH {SQL_FACTS},
    big AS (SELECT * FROM facts WHERE amount > (SELECT avg(amount) FROM facts))
    SELECT country, category, count(*) AS lines, CAST(max(amount) AS DECIMAL(18,4)) AS largest
    FROM big GROUP BY 1, 2"""
)
def ephemeral_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of two ephemeral models: both end up inside one query."""
    space = raw_namespace(spark, sf_dir)
    models = retail_models(space)
    big = Model(
        "big_lines",
        "SELECT f.* FROM {{ ref('order_facts') }} f "
        "CROSS JOIN (SELECT avg(amount) AS usual FROM {{ ref('order_facts') }}) WHERE amount > usual",
        EPHEMERAL,
    )
    report = Model(
        "big_by_country",
        "SELECT country, category, count(*) AS lines, max(amount) AS largest "
        "FROM {{ ref('big_lines') }} GROUP BY country, category",
    )
    models |= {m.name: m for m in (big, report)}
    return spark.sql(compile_model(report, models))


@query(
    """SELECT o_custkey, count(*) AS orders, max(CAST(o_orderdate AS DATE)) AS last_order,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS revenue
       FROM orders GROUP BY 1"""
)
def incremental_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first build up to 1998, then an incremental run that merges customers with news."""
    space = raw_namespace(spark, sf_dir)
    lake = Lakehouse(spark, scratch_path(spark, "incremental-model"))
    model = Model(
        "customer_totals",
        f"""
        SELECT o_custkey, count(*) AS orders, max(CAST(o_orderdate AS DATE)) AS last_order,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS revenue
        FROM `{space}`.sales
        WHERE o_orderdate < {{{{ var('until') }}}}
        {{% if is_incremental() %}}
          AND o_custkey IN (SELECT o_custkey FROM `{space}`.sales
                            WHERE o_orderdate > (SELECT max(last_order) FROM {{{{ this }}}}))
        {{% endif %}}
        GROUP BY o_custkey
        """,
        INCREMENTAL,
        namespace=f"{space}_{lake.root[-8:]}",
        unique_key=("o_custkey",),
        order_by=("last_order",),
    )
    first = {"until": "1998-01-01"}
    materialize(lake, model, compile_model(model, variables=first), incremental=False)
    later = {"until": "9999-01-01"}
    materialize(lake, model, compile_model(model, variables=later, incremental=True), incremental=True)
    return lake.read(model.table)


@query(
    """SELECT p_name, count(*) AS records,
              CAST(sum(CAST(p_size AS DECIMAL(28,6))) AS DECIMAL(28,2)) AS total_p_size
    FROM part GROUP BY 1"""
)
def suggested_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "p_partid")
    return suggest_summary(parts)[0]
