"""Bills, comparisons, credits and quotas for all tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dims
from millrace.queries import inputs as I
from millrace.queries import query
from millrace.usage import credits as C
from millrace.usage import money, pricing, quotas, sizing, summary

MONEY = "DECIMAL(24,8)"

SQL_PLANS = ", ".join(
    [
        I.sql_dim(
            "plans",
            dims.PLANS,
            "plan VARCHAR; display_name VARCHAR; monthly_minimum DECIMAL(12,2); commitments BOOLEAN; "
            "free_tier_bound BOOLEAN; max_warehouses INT; max_warehouse_size VARCHAR; "
            "daily_ccu DOUBLE; monthly_ccu DOUBLE; storage_gb DOUBLE; ingest_gb DOUBLE; "
            "daily_tasks DOUBLE; max_concurrent INT; max_users INT; retention INT",
        ),
        I.sql_dim(
            "bands",
            dims.FEE_BANDS,
            "plan VARCHAR; lo DECIMAL(12,2); hi DECIMAL(12,2); rate DECIMAL(6,4)",
        ),
        I.sql_dim(
            "addons", dims.ADDONS, "plan VARCHAR; meter VARCHAR; included DECIMAL(18,6); unit_price DECIMAL(8,4)"
        ),
        I.sql_dim("terms", dims.COMMITMENT_TIERS, "term INT; discount DECIMAL(6,4)"),
        I.sql_dim("bonuses", dims.CREDIT_TIERS, "threshold DECIMAL(12,2); bonus DECIMAL(6,4)"),
    ]
)

#: A baseline for the dividend: what the tenant's queries scanned this month.
SQL_SCANNED = f"""scanned AS (
    SELECT 'c' || user_id AS tenant_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS gb_scanned
    FROM events WHERE event_type = 'view' GROUP BY 1)"""


def _bill_sql(account_rows: str) -> str:
    """CTEs that end in ``bills``, with the fee as a join of spend and bands."""
    return f"""{I.SQL_USAGE}, {SQL_PLANS}, {I.SQL_ACCOUNTS}, {SQL_SCANNED},
  acc AS ({account_rows}),
  lines AS (
    SELECT s.tenant_id, s.period_start, a.plan, a.term_months, a.credits_balance_usd, a.baseline, a.gb_scanned,
      s.meter, s.quantity, s.infra_cost_usd,
      CASE WHEN s.infra_cost_usd > 0 OR s.quantity > 0 THEN s.infra_cost_usd END AS infra_amount,
      CASE WHEN d.included IS NOT NULL AND s.quantity > d.included
           THEN CAST(CAST(s.quantity - d.included AS DECIMAL(20,9)) * d.unit_price AS {MONEY}) END AS addon_amount,
      CASE WHEN d.included IS NOT NULL AND s.quantity > d.included
           THEN CAST(s.quantity - d.included AS DECIMAL(20,9)) END AS addon_quantity, d.unit_price
    FROM summary s JOIN acc a USING (tenant_id)
    LEFT JOIN addons d ON d.plan = a.plan AND d.meter = s.meter),
  base AS (
    SELECT tenant_id, period_start, plan, any_value(term_months) AS term_months,
      any_value(credits_balance_usd) AS balance, any_value(baseline) AS baseline, any_value(gb_scanned) AS gb_scanned,
      CAST(coalesce(sum(infra_amount), 0) AS {MONEY}) AS infra,
      CAST(coalesce(sum(addon_amount), 0) AS {MONEY}) AS addons,
      CAST(coalesce(sum(quantity) FILTER (WHERE meter = '{dims.COMPUTE}'), 0) AS DOUBLE) AS ccu,
      CAST(coalesce(sum(infra_cost_usd) FILTER (WHERE meter = '{dims.COMPUTE}'), 0) AS DOUBLE) AS ccu_cost
    FROM lines GROUP BY tenant_id, period_start, plan),
  fees AS (
    SELECT b.tenant_id, b.period_start, b.plan, CAST(sum(CAST(CAST(least(b.infra, coalesce(CAST(x.hi AS {MONEY}), b.infra)) - x.lo AS {MONEY}) * x.rate AS {MONEY})) AS {MONEY}) AS fee
    FROM base b JOIN bands x ON x.plan = b.plan AND x.lo < b.infra GROUP BY 1, 2, 3),
  step1 AS (
    SELECT b.*, p.display_name, p.monthly_minimum, p.commitments, coalesce(f.fee, 0) AS fee,
      CASE WHEN b.baseline IS NOT NULL AND b.gb_scanned > 0 AND b.baseline * b.gb_scanned > b.ccu AND b.ccu > 0
        THEN CAST((b.baseline * b.gb_scanned - b.ccu) * (b.ccu_cost / b.ccu) AS {MONEY}) ELSE CAST(0 AS {MONEY}) END AS saved
    FROM base b JOIN plans p USING (plan) LEFT JOIN fees f USING (tenant_id, period_start, plan)),
  step2 AS (
    SELECT *, least(CAST(saved * CAST(0.30 AS DECIMAL(6,4)) AS {MONEY}), CAST(fee AS {MONEY})) AS success FROM step1),
  step3 AS (
    SELECT *, CASE WHEN commitments AND term_months > 0 THEN
        -CAST(CAST(fee + success + addons AS {MONEY}) * (SELECT max(discount) FROM terms WHERE term <= term_months) AS {MONEY})
      ELSE CAST(0 AS {MONEY}) END AS commitment FROM step2),
  step4 AS (
    SELECT *, CASE WHEN monthly_minimum > 0 THEN
        CAST(greatest(monthly_minimum - (fee + success + addons + commitment), 0) AS {MONEY}) ELSE 0 END AS minimum FROM step3),
  step5 AS (
    SELECT *, CAST(fee + success + minimum AS {MONEY}) AS platform_fee,
      CAST(infra + fee + success + minimum + addons AS {MONEY}) AS subtotal FROM step4),
  step6 AS (
    SELECT *, -CAST(greatest(least(balance, CAST(subtotal + commitment AS {MONEY})), 0) AS {MONEY}) AS credits FROM step5),
  bills AS (
    SELECT *, CAST(commitment + credits AS {MONEY}) AS discounts,
      CAST(greatest(subtotal + commitment + credits, 0) AS {MONEY}) AS total FROM step6)"""


FULL_ACCOUNTS = """SELECT a.tenant_id, a.plan, a.term_months, a.credits_balance_usd,
      CAST(30.0 AS DOUBLE) AS baseline, coalesce(s.gb_scanned, 0) AS gb_scanned
    FROM accounts a LEFT JOIN scanned s USING (tenant_id)"""
PLAIN_ACCOUNTS = """SELECT tenant_id, plan, term_months, CAST(0 AS DECIMAL(24,8)) AS credits_balance_usd,
      CAST(NULL AS DOUBLE) AS baseline, 0 AS gb_scanned FROM accounts"""
EVERY_PLAN = """SELECT a.tenant_id, p.plan, a.term_months, CAST(0 AS DECIMAL(24,8)) AS credits_balance_usd,
      CAST(NULL AS DOUBLE) AS baseline, 0 AS gb_scanned FROM accounts a CROSS JOIN plans p"""


def full_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a baseline of 30 compute minutes per GB and what was scanned."""
    views = I.table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    scanned = views.groupBy(F.concat(F.lit("c"), "user_id").alias("tenant_id")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("gb_scanned")
    )
    joined = I.accounts(spark, sf_dir).join(scanned, "tenant_id", "left")
    return joined.withColumn("baseline_ccu_per_gb", F.lit(30.0)).withColumn(
        "gb_scanned", F.coalesce("gb_scanned", F.lit(0.0))
    )


def plain_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.accounts(spark, sf_dir).drop("credits_balance_usd")


def full_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = pricing.RateCard.default(spark)
    return pricing.price(I.usage_summary(spark, sf_dir), full_accounts(spark, sf_dir), card)


def plain_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = pricing.RateCard.default(spark)
    return pricing.price(I.usage_summary(spark, sf_dir), plain_accounts(spark, sf_dir), card)


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("period_start", F.to_date("period_start"))


BILL_COLUMNS = {
    "infrastructure_usd": "infra",
    "fee_usd": "fee",
    "addons_usd": "addons",
    "success_fee_usd": "success",
    "commitment_usd": "commitment",
    "minimum_usd": "minimum",
    "credits_usd": "credits",
    "platform_fee_usd": "platform_fee",
    "subtotal_usd": "subtotal",
    "discounts_usd": "discounts",
    "total_usd": "total",
}


def _bill_select(*names: str) -> str:
    chosen = ", ".join(f"CAST({BILL_COLUMNS[n]} AS DECIMAL(18,4)) AS {n}" for n in names)
    return f"{_bill_sql(FULL_ACCOUNTS)} SELECT tenant_id, period_start, plan, {chosen} FROM bills"


def _bill_columns(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    bills = dated(full_bills(spark, sf_dir))
    return bills.select(*pricing.BILL_KEYS, *[money.shown(F.col(n)).alias(n) for n in names])


@query(_bill_select(*BILL_COLUMNS))
def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bill, one row per tenant and month."""
    return _bill_columns(spark, sf_dir, *BILL_COLUMNS)


@query(
    f"""{I.SQL_USAGE}, a AS (
      SELECT 'c' || c_custkey AS tenant_id, {I.sql_choose('c_mktsegment', I.PLAN_OF, 'retired')} AS plan
      FROM customer WHERE c_custkey % 7 > 0)
    SELECT s.tenant_id, s.period_start, s.meter, s.quantity,
      CASE WHEN a.tenant_id IS NULL THEN 'no account' ELSE 'unknown plan' END AS reason
    FROM summary s LEFT JOIN a USING (tenant_id) WHERE a.tenant_id IS NULL OR a.plan = 'retired'"""
)
def unbilled_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage that no bill holds: tenants without an account, and accounts on a plan without prices."""
    known = I.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 > 0).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("tenant_id"),
        I.choose(F.col("c_mktsegment"), I.PLAN_OF, "retired").alias("plan"),
    )
    card = pricing.RateCard.default(spark)
    lines = pricing.unbilled_usage(I.usage_summary(spark, sf_dir), known, card)
    return dated(lines).select("tenant_id", "period_start", "meter", "quantity", "reason")


@query(
    f"""{_bill_sql(PLAIN_ACCOUNTS)}
    SELECT tenant_id, period_start, plan, meter, quantity, CAST(infra_amount AS DECIMAL(18,4)) AS infra_usd
    FROM lines WHERE infra_amount IS NOT NULL"""
)
def infra_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = dated(pricing.line_items(plain_bills(spark, sf_dir)))
    return items.filter(F.col("kind") == "infrastructure").select(
        *pricing.BILL_KEYS, "meter", "quantity", money.shown(F.col("amount_usd")).alias("infra_usd")
    )


@query(
    f"""{_bill_sql(PLAIN_ACCOUNTS)}
    SELECT tenant_id, period_start, plan, meter, addon_quantity AS quantity,
           CAST(addon_amount AS DECIMAL(18,4)) AS addon_usd
    FROM lines WHERE addon_amount IS NOT NULL"""
)
def addon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = dated(pricing.line_items(plain_bills(spark, sf_dir)))
    return items.filter(F.col("kind") == "addon").select(
        *pricing.BILL_KEYS, "meter", "quantity", money.shown(F.col("amount_usd")).alias("addon_usd")
    )


@query(
    f"""WITH {SQL_PLANS}, spend AS (
      SELECT o_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'team' WHEN 'BUILDING' THEN 'business' WHEN 'FURNITURE' THEN 'enterprise' ELSE 'community' END AS plan,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) / 20 AS DECIMAL(24,8)) AS infra_usd
      FROM (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,4)) AS o_totalprice FROM orders) JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    paid AS (SELECT s.o_custkey, sum(CAST(CAST(least(infra_usd, coalesce(hi, infra_usd)) - lo AS DECIMAL(24,8)) * rate AS DECIMAL(24,8))) AS fee
      FROM spend s JOIN bands b ON b.plan = s.plan AND lo < infra_usd GROUP BY 1)
    SELECT s.o_custkey, s.plan, CAST(infra_usd AS DECIMAL(18,4)) AS infra_usd,
      CAST(coalesce(fee, 0) AS DECIMAL(18,4)) AS platform_fee_usd,
      CAST(CAST(coalesce(fee, 0) AS DOUBLE) / CAST(infra_usd AS DOUBLE) AS DECIMAL(9,4)) AS blended_rate
    FROM spend s LEFT JOIN paid p USING (o_custkey)"""
)
def platform_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive fee on a twentieth of what each customer ordered: all bands occur."""
    plan = I.choose(
        F.col("c_mktsegment"),
        {"AUTOMOBILE": "team", "BUILDING": "business", "FURNITURE": "enterprise"},
        "community",
    )
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,4)").alias("price")
    )
    spend = (
        orders.join(I.table(spark, sf_dir, "customer"), "c_custkey")
        .groupBy(F.col("c_custkey").alias("o_custkey"), plan.alias("plan"))
        .agg((F.sum("price").cast("double") / 20).cast(money.AMOUNT).alias("infra_usd"))
    )
    out = pricing.platform_fees(spend, dims.fee_bands(spark))
    return out.select(
        "o_custkey",
        "plan",
        money.shown(F.col("infra_usd")).alias("infra_usd"),
        money.shown(F.col("platform_fee_usd")).alias("platform_fee_usd"),
        money.part(F.col("platform_fee_usd"), F.col("infra_usd")).cast("decimal(9,4)").alias("blended_rate"),
    )


@query(
    """WITH daily AS (
      SELECT 'c' || user_id AS tenant_id, CAST(ts AS DATE) AS day,
        CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS ccu_minutes,
        CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS gb_scanned
      FROM events GROUP BY 1, 2)
    SELECT *, CAST(CASE WHEN sum(gb_scanned) OVER w > 0 THEN
        CAST(sum(ccu_minutes) OVER w AS DOUBLE) / CAST(sum(gb_scanned) OVER w AS DOUBLE) END AS DECIMAL(18,6)) AS baseline_ccu_per_gb
    FROM daily WINDOW w AS (PARTITION BY tenant_id ORDER BY day
      RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
)
def efficiency_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    daily = I.table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("c"), "user_id").alias("tenant_id"), F.to_date("ts").alias("day")
    ).agg(
        F.sum(F.when(F.col("event_type") == "view", value).otherwise(zero)).cast("decimal(20,2)").alias("ccu_minutes"),
        F.sum(F.when(F.col("event_type") == "click", value).otherwise(zero)).cast("decimal(20,2)").alias("gb_scanned"),
    )
    out = pricing.efficiency_baseline(daily)
    return out.withColumn("baseline_ccu_per_gb", F.col("baseline_ccu_per_gb").cast("decimal(18,6)"))


@query(_bill_select("success_fee_usd", "fee_usd"))
def efficiency_dividend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_columns(spark, sf_dir, "success_fee_usd", "fee_usd")


@query(_bill_select("commitment_usd"))
def commitment_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_columns(spark, sf_dir, "commitment_usd")


@query(_bill_select("minimum_usd"))
def minimum_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_columns(spark, sf_dir, "minimum_usd")


@query(_bill_select("credits_usd"))
def credits_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_columns(spark, sf_dir, "credits_usd")


@query(
    f"""{_bill_sql(FULL_ACCOUNTS)}
    SELECT tenant_id, period_start, plan, CAST(infra AS DECIMAL(18,4)) AS infrastructure_usd,
      CAST(platform_fee AS DECIMAL(18,4)) AS platform_fee_usd, CAST(addons AS DECIMAL(18,4)) AS addons_usd,
      CAST(discounts AS DECIMAL(18,4)) AS discounts_usd, CAST(subtotal AS DECIMAL(18,4)) AS subtotal_usd,
      CAST(total AS DECIMAL(18,4)) AS total_usd,
      CAST(CAST(total AS DOUBLE) / CAST(infra AS DOUBLE) AS DECIMAL(18,3)) AS effective_markup FROM bills"""
)
def bill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by line kind, added up from the line items."""
    totals = dated(pricing.bill_totals(pricing.line_items(full_bills(spark, sf_dir))))
    shown = [c for c in totals.columns if c.endswith("_usd")]
    return totals.withColumns({c: money.shown(F.col(c)) for c in shown})


@query(
    f"""{_bill_sql(EVERY_PLAN)}
    SELECT tenant_id, period_start, plan, display_name, CAST(total AS DECIMAL(18,4)) AS total_usd,
      CAST(CAST(total AS DOUBLE) / CAST(infra AS DOUBLE) AS DECIMAL(18,3)) AS effective_markup FROM bills"""
)
def compare_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = pricing.RateCard.default(spark)
    out = pricing.compare_plans(I.usage_summary(spark, sf_dir), plain_accounts(spark, sf_dir), card)
    return dated(out).withColumn("total_usd", money.shown(F.col("total_usd")))


@query(
    f"""WITH {I.SQL_RATES}, {I.SQL_SIZES}, {I.SQL_QUERY_LOG},
    w AS (SELECT warehouse_id, any_value(vcpus) AS vcpus, any_value(gb_ram) AS gb_ram,
        CAST(sum(CAST(wall_seconds AS DECIMAL(18,6))) AS DECIMAL(20,6)) AS hours
      FROM query_log JOIN sizes USING (size) GROUP BY 1)
    SELECT w.*, provider, CAST(vcpus * vcpu_hour + gb_ram * gb_ram_hour AS DECIMAL(18,6)) AS usd_per_hour,
      CAST((vcpus * vcpu_hour + gb_ram * gb_ram_hour) * CAST(hours AS DOUBLE) AS DECIMAL(18,4)) AS workload_usd
    FROM w CROSS JOIN rates"""
)
def compare_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each warehouse's work would cost on every provider (a second counted as an hour)."""
    shape = dims.sizes(spark).select("size", "vcpus", "gb_ram")
    work = (
        I.query_log(spark, sf_dir)
        .join(F.broadcast(shape), "size")
        .groupBy("warehouse_id")
        .agg(
            F.any_value("vcpus").alias("vcpus"),
            F.any_value("gb_ram").alias("gb_ram"),
            F.sum(F.col("wall_seconds").cast("decimal(18,6)")).cast("decimal(20,6)").alias("hours"),
        )
    )
    return pricing.compare_providers(work, dims.rates(spark))


SQL_PLATFORMS = I.sql_dim("platforms", dims.PLATFORM_PRICES, "platform VARCHAR; price DOUBLE")


@query(
    f"""WITH {I.SQL_RATES}, {SQL_PLANS}, {SQL_PLATFORMS}, {I.SQL_ACCOUNTS},
    w AS (SELECT 'c' || user_id AS tenant_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS ccu_hours
      FROM events WHERE event_type = 'view' GROUP BY 1),
    x AS (SELECT tenant_id, provider, plan, ccu_hours,
        CAST((vcpu_hour + 4 * gb_ram_hour) * CAST(ccu_hours AS DOUBLE) AS DECIMAL(24,8)) AS infra
      FROM w JOIN accounts USING (tenant_id) JOIN rates USING (provider)),
    f AS (SELECT tenant_id, sum(CAST(CAST(least(infra, coalesce(hi, infra)) - lo AS DECIMAL(24,8)) * rate AS DECIMAL(24,8))) AS fee
      FROM x JOIN bands USING (plan) WHERE lo < infra GROUP BY 1),
    y AS (SELECT x.*, CAST(infra + coalesce(fee, 0) AS DOUBLE) / CAST(ccu_hours AS DOUBLE) AS all_in
      FROM x LEFT JOIN f USING (tenant_id))
    SELECT tenant_id, provider, plan, ccu_hours, platform, CAST(all_in AS DECIMAL(18,5)) AS all_in_usd_per_ccu_hour,
      CAST(price * CAST(ccu_hours AS DOUBLE) AS DECIMAL(18,4)) AS platform_usd,
      CASE WHEN all_in > 0 THEN CAST(price / all_in AS DECIMAL(18,1)) END AS cheaper_by
    FROM y CROSS JOIN platforms"""
)
def compare_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = I.table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    work = views.groupBy(F.concat(F.lit("c"), "user_id").alias("tenant_id")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(20,2)").alias("ccu_hours")
    )
    accounts = I.accounts(spark, sf_dir).select("tenant_id", "provider", "plan")
    joined = work.join(accounts, "tenant_id").select("tenant_id", "provider", "plan", "ccu_hours")
    return pricing.compare_platforms(
        joined, dims.rates(spark), dims.platform_prices(spark), dims.fee_bands(spark)
    )


@query(
    f"""WITH {I.SQL_RATES}, {SQL_PLANS}, {I.SQL_ACCOUNTS}, {I.SQL_QUERY_LOG},
    q AS (SELECT q.query_id, q.provider, q.spot, a.plan, CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(20,9)) AS ccu_minutes
      FROM query_log q JOIN events e ON CAST(e.event_id AS VARCHAR) = q.query_id JOIN accounts a ON a.tenant_id = q.tenant_id),
    i AS (SELECT q.*, CAST(CAST(ccu_minutes AS DOUBLE) * ((1 * vcpu_hour + 4 * gb_ram_hour)
        * CASE WHEN spot THEN 1.0::DOUBLE - spot_discount ELSE 1.0::DOUBLE END / 60.0::DOUBLE) AS DECIMAL(24,8)) AS infra,
        coalesce((SELECT rate FROM bands b WHERE b.plan = q.plan AND lo = 0), 0) AS rate
      FROM q JOIN rates USING (provider))
    SELECT query_id, provider, plan, spot, ccu_minutes, CAST(infra AS DECIMAL(18,6)) AS infrastructure_usd,
      CAST(CAST(infra * rate AS DECIMAL(24,8)) AS DECIMAL(18,6)) AS fee_usd,
      CAST(CAST(infra * (1 + rate) AS DECIMAL(24,8)) AS DECIMAL(18,6)) AS total_usd FROM i"""
)
def query_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A query runs a compute minute for every GB it scans.
    minutes = F.expr("CAST(bytes_scanned * CAST(0.000000001 AS DECIMAL(10,9)) AS DECIMAL(20,9))")
    accounts = I.accounts(spark, sf_dir).select("tenant_id", "plan")
    queries = I.query_log(spark, sf_dir).withColumn("ccu_minutes", minutes).join(accounts, "tenant_id").select(
        "query_id", "provider", "region", "plan", "spot", "ccu_minutes"
    )
    out = pricing.query_costs(queries, dims.rates(spark), dims.region_indexes(spark), dims.fee_bands(spark))
    six = ["infrastructure_usd", "fee_usd", "total_usd"]
    return out.drop("region").withColumns({c: F.col(c).cast("decimal(18,6)") for c in six})


@query(
    f"""{_bill_sql(PLAIN_ACCOUNTS).replace("FROM events", f"FROM events WHERE ts <= TIMESTAMP '{I.AS_OF}'", 1)}
    SELECT tenant_id, period_start, plan, CAST(15.5::DOUBLE / 31 AS DECIMAL(9,4)) AS elapsed_fraction,
      CAST(total AS DECIMAL(18,4)) AS to_date_usd, CAST(CAST(total AS DOUBLE) * 2 AS DECIMAL(18,4)) AS projected_usd,
      CAST(infra AS DECIMAL(18,4)) AS infrastructure_to_date_usd,
      CAST(platform_fee AS DECIMAL(18,4)) AS platform_fee_to_date_usd
    FROM bills WHERE period_start = DATE '2024-01-01'"""
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's bill projected from noon of the 16th: half of January is over."""
    as_of = F.lit(I.AS_OF).cast("timestamp")
    so_far = I.usage_events(spark, sf_dir).filter(F.col("occurred_at") <= as_of.cast("timestamp_ntz"))
    used = summary.summarize(so_far, providers=False).drop("events")
    card = pricing.RateCard.default(spark)
    bills_now = pricing.price(used, plain_accounts(spark, sf_dir), card)
    return dated(pricing.forecast(bills_now, as_of))


@query(
    f"""{_bill_sql(PLAIN_ACCOUNTS)},
    owed AS (SELECT b.tenant_id, period_start, b.plan, CAST(greatest(subtotal + commitment, 0) AS {MONEY}) AS payable,
        a.credits_balance_usd AS start_balance FROM bills b JOIN accounts a ON a.tenant_id = b.tenant_id),
    run AS (SELECT *, sum(payable) OVER (PARTITION BY tenant_id, plan ORDER BY period_start) AS upto FROM owed)
    SELECT tenant_id, period_start, plan, TIMESTAMP '2024-02-01' AS issued_at, TIMESTAMP '2024-03-02' AS due_at,
      'INV-' || strftime(period_start, '%Y%m') || '-' || upper(substr(md5(tenant_id || '/' || plan), 1, 8)) AS number,
      CAST(payable AS DECIMAL(18,4)) AS payable_usd,
      CAST(least(start_balance, upto) - least(start_balance, upto - payable) AS DECIMAL(18,4)) AS credits_applied_usd,
      CAST(payable - (least(start_balance, upto) - least(start_balance, upto - payable)) AS DECIMAL(18,4)) AS amount_due_usd
    FROM run"""
)
def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = I.accounts(spark, sf_dir).select(
        "tenant_id", F.col("credits_balance_usd").alias("balance_usd")
    )
    out = pricing.invoices(
        plain_bills(spark, sf_dir), balances, F.lit("2024-02-01").cast("timestamp_ntz")
    )
    shown = [c for c in out.columns if c.endswith("_usd")]
    return dated(out).withColumns({c: money.shown(F.col(c)) for c in shown})


# ---------------------------------------------------------------------- credits

SQL_PURCHASES = """purchases AS (
    SELECT o_orderkey AS grant_id, 'c' || o_custkey AS tenant_id,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS purchased_usd, o_orderdate AS granted_at
    FROM orders WHERE o_orderpriority = '1-URGENT')"""
SQL_GRANTS = f"""{SQL_PURCHASES}, rated AS (
    SELECT p.*, coalesce((SELECT max(bonus) FROM bonuses WHERE threshold <= purchased_usd), 0) AS bonus_rate FROM purchases p),
  grants AS (SELECT *, CAST(purchased_usd * bonus_rate AS DECIMAL(24,8)) AS bonus_usd,
      granted_at + INTERVAL 365 DAYS AS expires_at FROM rated)"""


def credit_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as credit purchases."""
    o = I.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return o.select(
        F.col("o_orderkey").alias("grant_id"),
        F.concat(F.lit("c"), "o_custkey").alias("tenant_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("purchased_usd"),
        F.col("o_orderdate").alias("granted_at"),
    )


def credit_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grant_credits(credit_purchases(spark, sf_dir), dims.credit_tiers(spark))


@query(
    f"""WITH {SQL_PLANS}, {SQL_GRANTS}
    SELECT grant_id, tenant_id, CAST(purchased_usd AS DECIMAL(18,4)) AS purchased_usd,
      CAST(bonus_usd AS DECIMAL(18,4)) AS bonus_usd, granted_at, expires_at FROM grants"""
)
def credit_grants_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit_grants(spark, sf_dir).select(
        "grant_id",
        "tenant_id",
        money.shown(F.col("purchased_usd")).alias("purchased_usd"),
        money.shown(F.col("bonus_usd")).alias("bonus_usd"),
        "granted_at",
        "expires_at",
    )


CREDIT_DAY = "1999-06-01"


@query(
    f"""WITH {SQL_PLANS}, {SQL_GRANTS}
    SELECT tenant_id, CAST(sum(purchased_usd + bonus_usd) AS DECIMAL(18,4)) AS balance_usd
    FROM grants WHERE TIMESTAMP '{CREDIT_DAY}' < expires_at GROUP BY 1"""
)
def credit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(CREDIT_DAY).cast("timestamp_ntz")
    out = C.credit_balance(credit_grants(spark, sf_dir), as_of)
    return out.withColumn("balance_usd", money.shown(F.col("balance_usd")))


@query(
    f"""WITH {SQL_PLANS}, {SQL_GRANTS},
    g AS (SELECT grant_id, tenant_id, purchased_usd + bonus_usd AS usd,
        sum(purchased_usd + bonus_usd) OVER (PARTITION BY tenant_id ORDER BY expires_at, granted_at, grant_id) AS hi
      FROM grants WHERE TIMESTAMP '{CREDIT_DAY}' < expires_at),
    c AS (SELECT charge_id, 'c' || o_custkey AS tenant_id, usd, sum(usd) OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate, charge_id) AS hi
      FROM (SELECT o_orderkey AS charge_id, o_custkey, o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(24,8)) AS usd
            FROM orders WHERE o_orderpriority <> '1-URGENT'))
    SELECT g.tenant_id, CAST(grant_id AS VARCHAR) AS grant_id, CAST(charge_id AS VARCHAR) AS charge_id,
      CAST(least(g.hi, c.hi) - greatest(g.hi - g.usd, c.hi - c.usd) AS DECIMAL(18,4)) AS burned_usd
    FROM g JOIN c ON c.tenant_id = g.tenant_id AND g.hi - g.usd < c.hi AND c.hi - c.usd < g.hi"""
)
def credit_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order burned which urgent purchase's credit, oldest credit first."""
    charges = I.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") != "1-URGENT").select(
        F.concat(F.lit("c"), "o_custkey").alias("tenant_id"),
        F.col("o_orderkey").alias("charge_id"),
        F.col("o_orderdate").alias("charged_at"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_usd"),
    )
    as_of = F.lit(CREDIT_DAY).cast("timestamp_ntz")
    out = C.burn_credits(credit_grants(spark, sf_dir), charges, as_of)
    return out.withColumn("burned_usd", money.shown(F.col("burned_usd")))


# ----------------------------------------------------------------------- quotas

SQL_LIMITS = f"""{SQL_PLANS}, {I.sql_dim('tiers', dims.FREE_TIERS,
    'provider VARCHAR; hours DOUBLE; vcpus DOUBLE; gb DOUBLE; free_gb DOUBLE')},
  free AS (SELECT *, CASE WHEN hours <= 0 THEN 0 ELSE hours * 60 * least(vcpus, gb / 4) END AS ccu FROM tiers),
  limits AS (
    SELECT plan, provider, max_warehouses, max_warehouse_size,
      CAST(CASE WHEN NOT free_tier_bound THEN daily_ccu ELSE ccu / 30 END AS DECIMAL(20,6)) AS daily_ccu_minutes,
      CAST(CASE WHEN NOT free_tier_bound THEN monthly_ccu ELSE ccu END AS DECIMAL(20,6)) AS monthly_ccu_minutes,
      CAST(CASE WHEN NOT free_tier_bound THEN storage_gb WHEN ccu IS NULL THEN NULL
           WHEN free_gb > 0 THEN free_gb ELSE storage_gb END AS DECIMAL(20,6)) AS storage_gb,
      CAST(CASE WHEN NOT free_tier_bound THEN ingest_gb WHEN ccu IS NULL THEN NULL
           WHEN free_gb > 0 AND free_gb < ingest_gb THEN free_gb ELSE ingest_gb END AS DECIMAL(20,6)) AS monthly_ingest_gb,
      CAST(daily_tasks AS DECIMAL(20,6)) AS daily_task_minutes
    FROM plans CROSS JOIN free)"""

SQL_REPORT = f"""WITH {SQL_LIMITS}, {I.SQL_ACCOUNTS}, log AS ({I.SQL_USAGE_LOG}),
  m AS (SELECT * FROM log WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at <= TIMESTAMP '{I.AS_OF}'),
  used AS (SELECT tenant_id, 'daily_ccu_minutes' AS limit_name, sum(quantity) AS used FROM m
      WHERE meter = '{dims.COMPUTE}' AND occurred_at >= TIMESTAMP '2024-01-16' GROUP BY 1
    UNION ALL SELECT tenant_id, 'monthly_ccu_minutes', sum(quantity) FROM m WHERE meter = '{dims.COMPUTE}' GROUP BY 1
    UNION ALL SELECT tenant_id, 'storage_gb', CAST(CAST(sum(quantity) AS DOUBLE) / 0.5::DOUBLE AS DECIMAL(28,9)) FROM m WHERE meter = '{dims.STORAGE}' GROUP BY 1
    UNION ALL SELECT tenant_id, 'monthly_ingest_gb', sum(quantity) FROM m WHERE meter = '{dims.INGEST}' GROUP BY 1
    UNION ALL SELECT tenant_id, 'daily_task_minutes', sum(quantity) FROM m
      WHERE meter = '{dims.TASKS}' AND occurred_at >= TIMESTAMP '2024-01-16' GROUP BY 1),
  names AS (SELECT * FROM (VALUES ('daily_ccu_minutes', 'CCU-min'), ('monthly_ccu_minutes', 'CCU-min'),
      ('storage_gb', 'GB'), ('monthly_ingest_gb', 'GB'), ('daily_task_minutes', 'task-min')) AS v(limit_name, unit)),
  report AS (
    SELECT a.tenant_id, a.plan, a.provider, n.limit_name, n.unit,
      CASE n.limit_name WHEN 'daily_ccu_minutes' THEN l.daily_ccu_minutes WHEN 'monthly_ccu_minutes' THEN l.monthly_ccu_minutes
        WHEN 'storage_gb' THEN l.storage_gb WHEN 'monthly_ingest_gb' THEN l.monthly_ingest_gb ELSE l.daily_task_minutes END AS limit_value,
      CAST(coalesce(u.used, 0) AS DECIMAL(20,6)) AS used
    FROM accounts a CROSS JOIN names n JOIN limits l ON l.plan = a.plan AND l.provider = a.provider
    LEFT JOIN used u ON u.tenant_id = a.tenant_id AND u.limit_name = n.limit_name),
  checked AS (
    SELECT *, limit_value IS NULL OR used <= limit_value AS allowed,
      CASE WHEN limit_value IS NOT NULL THEN CAST(greatest(limit_value - used, 0) AS DECIMAL(20,6)) END AS remaining,
      CAST(CASE WHEN limit_value > 0 THEN least(CAST(used AS DOUBLE) / CAST(limit_value AS DOUBLE), 1.0) ELSE 0 END AS DECIMAL(9,4)) AS utilization
    FROM report)"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = quotas.effective_limits(dims.plans(spark), dims.free_tiers(spark))
    as_of = F.lit(I.AS_OF).cast("timestamp")
    out = quotas.quota_report(I.usage_log(spark, sf_dir), I.accounts(spark, sf_dir), limits, as_of)
    return out.drop("asked")


@query(
    f"""WITH {SQL_LIMITS}, {I.SQL_ACCOUNTS}
    SELECT a.tenant_id, a.plan, a.provider, l.* EXCLUDE (plan, provider)
    FROM accounts a JOIN limits l ON l.plan = a.plan AND l.provider = a.provider"""
)
def effective_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = quotas.effective_limits(dims.plans(spark), dims.free_tiers(spark))
    accounts = I.accounts(spark, sf_dir).select("tenant_id", "plan", "provider")
    return quotas.tenant_limits(accounts, limits)


@query(f"{SQL_REPORT} SELECT * FROM checked")
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir)


@query(f"{SQL_REPORT} SELECT * FROM checked WHERE limit_name LIKE '%ccu%'")
def quota_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).filter(F.col("limit_name").contains("ccu"))


@query(f"{SQL_REPORT} SELECT * FROM checked WHERE limit_name = 'storage_gb'")
def quota_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).filter(F.col("limit_name") == "storage_gb")


@query(f"{SQL_REPORT} SELECT * FROM checked WHERE limit_name IN ('monthly_ingest_gb', 'daily_task_minutes')")
def quota_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).filter(
        F.col("limit_name").isin("monthly_ingest_gb", "daily_task_minutes")
    )


@query(
    f"""{SQL_REPORT}, n AS (SELECT *, CASE limit_name WHEN 'daily_ccu_minutes' THEN 1 WHEN 'monthly_ccu_minutes' THEN 2
        WHEN 'storage_gb' THEN 3 WHEN 'monthly_ingest_gb' THEN 4 ELSE 5 END AS place FROM checked WHERE NOT allowed)
    SELECT tenant_id, plan, provider, min_by(limit_name, place) AS limit_name FROM n GROUP BY 1, 2, 3"""
)
def quota_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.refused(report(spark, sf_dir))


@query(
    f"""WITH {SQL_LIMITS}, {I.SQL_ACCOUNTS}, {I.SQL_SIZES}, {I.SQL_QUERY_LOG},
    t AS (SELECT tenant_id, max(s.vcpus) AS largest, count(DISTINCT warehouse_id) AS n
      FROM query_log JOIN sizes s USING (size) GROUP BY 1)
    SELECT a.tenant_id, a.plan, 'max_warehouse_size' AS limit_name, z.vcpus AS limit_value,
      coalesce(t.largest, 0) AS used, z.vcpus IS NULL OR coalesce(t.largest, 0) <= z.vcpus AS allowed
    FROM accounts a JOIN limits l ON l.plan = a.plan AND l.provider = a.provider
    LEFT JOIN sizes z ON z.size = l.max_warehouse_size LEFT JOIN t ON t.tenant_id = a.tenant_id
    UNION ALL
    SELECT a.tenant_id, a.plan, 'max_warehouses', l.max_warehouses, coalesce(t.n, 0),
      l.max_warehouses IS NULL OR coalesce(t.n, 0) < l.max_warehouses
    FROM accounts a JOIN limits l ON l.plan = a.plan AND l.provider = a.provider
    LEFT JOIN t ON t.tenant_id = a.tenant_id"""
)
def warehouse_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = quotas.effective_limits(dims.plans(spark), dims.free_tiers(spark))
    warehouses = I.query_log(spark, sf_dir).select("tenant_id", "warehouse_id", "size")
    return quotas.warehouse_checks(warehouses, I.accounts(spark, sf_dir), limits, dims.sizes(spark))


@query(
    f"""{_bill_sql(PLAIN_ACCOUNTS)}
    SELECT b.tenant_id, period_start, b.plan, CAST(c_acctbal AS DECIMAL(18,2)) AS cap_usd,
      CAST(total + 10 AS DECIMAL(18,4)) AS projected_usd
    FROM bills b JOIN customer ON 'c' || c_custkey = b.tenant_id
    WHERE total + 10 > CAST(c_acctbal AS DECIMAL(18,2))"""
)
def budget_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as caps, ten dollars asked for on top."""
    caps = I.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("tenant_id"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("cap_usd"),
        F.lit(10).cast("decimal(18,2)").alias("asked_usd"),
    )
    return dated(quotas.budget_breaches(plain_bills(spark, sf_dir), caps))


# ------------------------------------------------------------------------ sizes


@query(
    f"""WITH {I.SQL_SIZES}, {I.SQL_QUERY_LOG}
    SELECT query_id, bytes_scanned, coalesce(
      (SELECT min_by(size, vcpus) FROM sizes WHERE vcpus >= bytes_scanned / 1000000.0::DOUBLE / 3600.0::DOUBLE), '4xl') AS recommended_size
    FROM query_log"""
)
def recommend_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = I.query_log(spark, sf_dir).select("query_id", "bytes_scanned")
    return sizing.recommend_sizes(log, dims.sizes(spark))


@query(
    f"""WITH {I.SQL_SIZES}, {I.SQL_RATES}, {I.SQL_QUERY_LOG},
    w AS (SELECT DISTINCT warehouse_id, size, provider, spot, min_clusters FROM query_log)
    SELECT warehouse_id, size, provider, spot, min_clusters,
      CAST((vcpus * vcpu_hour + gb_ram * gb_ram_hour) * CASE WHEN spot THEN 1.0::DOUBLE - spot_discount ELSE 1.0::DOUBLE END
        * greatest(min_clusters, 1) AS DECIMAL(18,4)) AS infra_usd_per_hour,
      ccu * greatest(min_clusters, 1) * 60 AS ccu_per_hour,
      CAST(ccu * greatest(min_clusters, 1) * 60 * 0.01::DOUBLE AS DECIMAL(18,4)) AS ccu_usd_per_hour,
      CAST((vcpus * vcpu_hour + gb_ram * gb_ram_hour) * CASE WHEN spot THEN 1.0::DOUBLE - spot_discount ELSE 1.0::DOUBLE END
        * greatest(min_clusters, 1) + ccu * greatest(min_clusters, 1) * 60 * 0.01::DOUBLE AS DECIMAL(18,4)) AS total_usd_per_hour
    FROM w JOIN sizes USING (size) JOIN rates USING (provider)"""
)
def size_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = I.query_log(spark, sf_dir)
    warehouses = log.select("warehouse_id", "size", "provider", "region", "spot", "min_clusters").distinct()
    priced = warehouses.withColumn("unit_price_usd", F.lit(0.01))
    out = sizing.size_costs(priced, dims.sizes(spark), dims.rates(spark), dims.region_indexes(spark))
    return out.drop("region", "unit_price_usd")
