"""Bills: infrastructure at cost, platform fee, add-ons, then reductions.

All tenants are priced in one plan.  A bill is worked out on one row per tenant
and period, left to right, because each step needs the totals of the ones
before it; the line items are unfolded from that row at the end.

Every function takes the dimensions it prices with, so another rate card is
just other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import dims
from millrace.functions.temporal import month_end, month_start
from millrace.operators.running import running_total
from millrace.usage import money
from millrace.usage.metering import node_cost_sql, priced_rates

def _zero() -> Column:
    return F.lit(0).cast(money.AMOUNT)


@dataclass(frozen=True)
class RateCard:
    """The dimensions and shares a bill is made with."""

    plans: DataFrame
    bands: DataFrame
    addons: DataFrame
    commitments: DataFrame
    efficiency_share: float = dims.EFFICIENCY_SHARE
    storage_markup: float = dims.STORAGE_MARKUP
    egress_markup: float = dims.EGRESS_MARKUP

    @classmethod
    def default(cls, spark: SparkSession, **overrides: object) -> RateCard:
        base = {
            "plans": dims.plans(spark),
            "bands": dims.fee_bands(spark),
            "addons": dims.addons(spark),
            "commitments": dims.commitment_tiers(spark),
        }
        return cls(**{**base, **overrides})


# ------------------------------------------------------------------ platform fee


def band_arrays(bands: DataFrame) -> DataFrame:
    """One row per plan with its bands in order."""
    band = F.struct("from_usd", "to_usd", "fee_rate")
    return bands.groupBy("plan").agg(F.array_sort(F.collect_list(band)).alias("bands"))


def progressive_fee_sql(spend: str) -> str:
    """Marginal fee: the spend inside each of the row's bands at the rate of that band."""
    inside = (
        f"CAST(greatest(least({spend}, coalesce(CAST(b.to_usd AS {money.AMOUNT}), {spend}))"
        f" - b.from_usd, 0) AS {money.AMOUNT})"
    )
    return (
        f"coalesce(aggregate(bands, CAST(0 AS {money.AMOUNT}), "
        f"(fee, b) -> CAST(fee + {inside} * b.fee_rate AS {money.AMOUNT})), 0)"
    )


def marginal_rate_sql(spend: str) -> str:
    """Rate of the band the spend lies in."""
    held = f"get(filter(bands, b -> b.to_usd IS NULL OR {spend} <= b.to_usd), 0).fee_rate"
    return f"coalesce({held}, CAST(0 AS DECIMAL(6,4)))"


def platform_fees(spending: DataFrame, bands: DataFrame, spend: str = "infra_usd") -> DataFrame:
    """``spending`` (with ``plan``) and its fee and blended rate."""
    by_plan = F.broadcast(band_arrays(bands))
    fee = progressive_fee_sql(f"CAST({spend} AS {money.AMOUNT})")
    blended = money.part(F.col("platform_fee_usd"), F.col(spend))
    return spending.join(by_plan, "plan", "left").select(
        *spending.columns,
        F.expr(f"CAST({fee} AS {money.AMOUNT}) AS platform_fee_usd"),
        blended.cast("decimal(9,6)").alias("blended_rate"),
    )


# ------------------------------------------------------------------------- bills


def priced_usage(summary: DataFrame, accounts: DataFrame, card: RateCard) -> DataFrame:
    """Usage lines with what they cost: infrastructure and add-on amounts per meter."""
    addons = card.addons.selectExpr("plan AS _plan", "meter AS _meter", "included", "unit_price")
    lines = summary.join(accounts, "tenant_id").join(
        F.broadcast(addons), F.expr("plan = _plan AND meter = _meter"), "left"
    )
    markup = (
        f"CAST(CASE meter WHEN '{dims.STORAGE}' THEN {card.storage_markup} "
        f"WHEN '{dims.EGRESS}' THEN {card.egress_markup} ELSE 0 END AS DECIMAL(6,4))"
    )
    return lines.selectExpr(
        *[f"`{c}`" for c in dict.fromkeys([*summary.columns, *accounts.columns])],
        "unit_price",
        f"CASE WHEN infra_cost_usd > 0 OR quantity > 0 "
        f"THEN CAST(infra_cost_usd * (1 + {markup}) AS {money.AMOUNT}) END AS infra_amount_usd",
        # No allowance in the row is an unlimited one, and gives NULL.
        f"CASE WHEN quantity > included "
        f"THEN CAST(quantity - included AS {money.QUANTITY}) END AS addon_quantity",
        f"CAST(addon_quantity * unit_price AS {money.AMOUNT}) AS addon_amount_usd",
    )


def unbilled_usage(summary: DataFrame, accounts: DataFrame, card: RateCard) -> DataFrame:
    """The lines of ``summary`` that no bill holds, with the ``reason``.

    Together with the lines of the bills these are all lines.
    """
    known = F.broadcast(card.plans.select(F.col("plan").alias("_known")))
    account = accounts.select("tenant_id", F.col("plan").alias("_plan"), F.lit(True).alias("_account"))
    reason = F.when(F.col("_account").isNull(), "no account").when(F.col("_known").isNull(), "unknown plan")
    joined = summary.join(account, "tenant_id", "left").join(known, F.expr("_plan = _known"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in summary.columns], reason.alias("reason")).filter(
        "reason IS NOT NULL"
    )


ACCOUNT_DEFAULTS = {
    "term_months": "0",
    "credits_balance_usd": "CAST(0 AS DECIMAL(24,8))",
    "baseline_ccu_per_gb": "CAST(NULL AS DOUBLE)",
    "gb_scanned": "CAST(0 AS DOUBLE)",
}


def full_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts (``tenant_id, plan``) with the optional columns filled in."""
    missing = {k: F.expr(v) for k, v in ACCOUNT_DEFAULTS.items() if k not in accounts.columns}
    return accounts.withColumns(missing) if missing else accounts


def price(summary: DataFrame, accounts: DataFrame, card: RateCard) -> DataFrame:
    """One row per tenant, period and plan with every amount of the bill.

    ``accounts``: ``tenant_id, plan`` and optionally ``term_months,
    credits_balance_usd, baseline_ccu_per_gb, gb_scanned``.  Usage of a tenant
    without an account or with an unknown plan has no bill; ``unbilled_usage`` lists it.
    """
    lines = priced_usage(summary, full_accounts(accounts), card)
    account_columns = ["plan", *ACCOUNT_DEFAULTS]
    compute = f"meter = '{dims.COMPUTE}'"
    base = lines.groupBy("tenant_id", "period_start", *account_columns).agg(
        F.expr(f"CAST(coalesce(sum(infra_amount_usd), 0) AS {money.AMOUNT}) AS infrastructure_usd"),
        F.expr(f"CAST(coalesce(sum(addon_amount_usd), 0) AS {money.AMOUNT}) AS addons_usd"),
        F.expr(f"CAST(coalesce(sum(quantity) FILTER (WHERE {compute}), 0) AS DOUBLE) AS _ccu"),
        F.expr(f"CAST(coalesce(sum(infra_cost_usd) FILTER (WHERE {compute}), 0) AS DOUBLE) AS _ccu_cost"),
        # One line per meter, so the list is as short as the list of meters.
        F.expr(
            "array_sort(collect_list(struct(meter, quantity, infra_cost_usd, infra_amount_usd, "
            "addon_quantity, addon_amount_usd, unit_price))) AS usage_lines"
        ),
    )
    plan = (
        card.plans.select("plan", "display_name", "monthly_minimum", "commitments")
        .join(F.broadcast(band_arrays(card.bands)), "plan", "left")
        .crossJoin(F.broadcast(tier_array(card.commitments, "tiers")))
    )
    money_of = lambda expression, name: f"CAST({expression} AS {money.AMOUNT}) AS {name}"
    tier = best_tier_sql("term_months", "tiers", "term_months", "discount")
    # Each amount may use the ones before it in the same select.
    return base.join(F.broadcast(plan), "plan").selectExpr(
        "tenant_id",
        "period_start",
        *account_columns,
        "display_name",
        "infrastructure_usd",
        "addons_usd",
        "usage_lines",
        money_of(
            f"IF(infrastructure_usd > 0, {progressive_fee_sql('infrastructure_usd')}, 0)", "fee_usd"
        ),
        money_of(
            "CASE WHEN gb_scanned > 0 AND baseline_ccu_per_gb * gb_scanned > _ccu AND _ccu > 0 "
            "THEN (baseline_ccu_per_gb * gb_scanned - _ccu) * (_ccu_cost / _ccu) ELSE 0 END",
            "saved_usd",
        ),
        money_of(
            f"least(CAST(saved_usd * CAST({card.efficiency_share} AS DECIMAL(6,4)) AS {money.AMOUNT}), fee_usd)",
            "success_fee_usd",
        ),
        money_of("fee_usd + success_fee_usd + addons_usd", "revenue_usd"),
        money_of(f"IF(commitments AND term_months > 0, -revenue_usd * {tier}, 0)", "commitment_usd"),
        money_of(
            "IF(monthly_minimum > 0, greatest(monthly_minimum - revenue_usd - commitment_usd, 0), 0)",
            "minimum_usd",
        ),
        money_of("fee_usd + success_fee_usd + minimum_usd", "platform_fee_usd"),
        money_of("infrastructure_usd + platform_fee_usd + addons_usd", "subtotal_usd"),
        money_of(
            f"-greatest(least(CAST(credits_balance_usd AS {money.AMOUNT}), subtotal_usd + commitment_usd), 0)",
            "credits_usd",
        ),
        money_of("commitment_usd + credits_usd", "discounts_usd"),
        money_of("greatest(subtotal_usd + discounts_usd, 0)", "total_usd"),
        f"{MARKUP_SQL} AS effective_markup",
    ).drop("revenue_usd")


#: Total per dollar of infrastructure.
MARKUP_SQL = (
    "CAST(IF(infrastructure_usd > 0, "
    "CAST(total_usd AS DOUBLE) / CAST(infrastructure_usd AS DOUBLE), 0) AS DECIMAL(18,3))"
)


def tier_array(tiers: DataFrame, out: str) -> DataFrame:
    """A tier dimension as one row with one array, to look tiers up without a join per row."""
    return tiers.agg(F.collect_list(F.struct(*tiers.columns)).alias(out))


def best_tier_sql(value: str, tiers: str, bound: str, gain: str) -> str:
    """The highest gain among the row's tiers whose bound is reached, else zero."""
    reached = f"transform(filter({tiers}, t -> {value} >= t.{bound}), t -> t.{gain})"
    return f"CAST(coalesce(array_max({reached}), 0) AS DECIMAL(6,4))"


# Kinds of line items.
KINDS = ["infrastructure", "platform_fee", "addon", "success_fee", "discount", "minimum"]

BILL_KEYS = ["tenant_id", "period_start", "plan"]


def _entry_sql(
    seq: int, kind: str, amount: str, meter: str = "CAST(NULL AS STRING)", quantity: str = "0",
    unit_price: str = "0",
) -> str:
    return (
        f"named_struct('seq', {seq}, 'kind', '{kind}', 'meter', {meter}, "
        f"'quantity', CAST({quantity} AS {money.QUANTITY}), "
        f"'unit_price_usd', CAST({unit_price} AS {money.RATE}), "
        f"'amount_usd', CAST({amount} AS {money.AMOUNT}))"
    )


def line_items(bills: DataFrame) -> DataFrame:
    """``tenant_id, period_start, plan, seq, kind, meter, quantity, unit_price_usd, amount_usd``."""
    price_per = "IF(u.quantity <> 0, CAST(u.infra_amount_usd AS DOUBLE) / CAST(u.quantity AS DOUBLE), 0)"
    infra = _entry_sql(1, "infrastructure", "u.infra_amount_usd", "u.meter", "u.quantity", price_per)
    addon = _entry_sql(3, "addon", "u.addon_amount_usd", "u.meter", "u.addon_quantity", "u.unit_price")
    blended = (
        "IF(infrastructure_usd <> 0, CAST(fee_usd AS DOUBLE) / CAST(infrastructure_usd AS DOUBLE), 0)"
    )
    single = [
        _entry_sql(2, "platform_fee", "fee_usd", quantity="infrastructure_usd", unit_price=blended),
        _entry_sql(4, "success_fee", "success_fee_usd"),
        _entry_sql(5, "discount", "commitment_usd"),
        _entry_sql(6, "minimum", "minimum_usd"),
        _entry_sql(7, "discount", "credits_usd"),
    ]
    return bills.selectExpr(
        *BILL_KEYS,
        "inline(concat("
        f"transform(filter(usage_lines, u -> u.infra_amount_usd IS NOT NULL), u -> {infra}), "
        f"transform(filter(usage_lines, u -> u.addon_amount_usd IS NOT NULL), u -> {addon}), "
        f"filter(array({', '.join(single)}), e -> e.amount_usd <> 0)))",
    )


def bill_totals(lines: DataFrame) -> DataFrame:
    """Totals by line kind, from the line items alone."""

    def total(name: str, *kinds: str) -> Column:
        listed = ", ".join(f"'{k}'" for k in kinds)
        summed = f"coalesce(sum(amount_usd) FILTER (WHERE kind IN ({listed})), 0)"
        return F.expr(f"CAST({summed} AS {money.AMOUNT}) AS {name}")

    return (
        lines.groupBy(*BILL_KEYS)
        .agg(
            total("infrastructure_usd", "infrastructure"),
            total("platform_fee_usd", "platform_fee", "minimum", "success_fee"),
            total("addons_usd", "addon"),
            total("discounts_usd", "discount"),
        )
        .selectExpr(
            "*",
            f"CAST(infrastructure_usd + platform_fee_usd + addons_usd AS {money.AMOUNT}) AS subtotal_usd",
            f"CAST(greatest(subtotal_usd + discounts_usd, 0) AS {money.AMOUNT}) AS total_usd",
            f"{MARKUP_SQL} AS effective_markup",
        )
    )


# ------------------------------------------------------------------- comparisons


def compare_plans(summary: DataFrame, accounts: DataFrame, card: RateCard) -> DataFrame:
    """Every tenant's period priced on every plan, cheapest first.

    Plans are a fixed handful, so this multiplies the accounts by that number.
    """
    plans = F.broadcast(card.plans.select("plan"))
    every = full_accounts(accounts).drop("plan").crossJoin(plans)
    bills = price(summary, every, card)
    return bills.select(*BILL_KEYS, "display_name", "total_usd", "effective_markup").orderBy(
        "tenant_id", "period_start", "total_usd", "plan"
    )


def compare_providers(
    workloads: DataFrame, rates: DataFrame, vcpus: str = "vcpus", gb_ram: str = "gb_ram",
    hours: str = "hours",
) -> DataFrame:
    """Cost of each workload (a machine shape for some hours) on every provider."""
    hour = F.expr(node_cost_sql(vcpus, gb_ram))
    return workloads.crossJoin(F.broadcast(rates)).select(
        *workloads.columns,
        "provider",
        hour.cast("decimal(18,6)").alias("usd_per_hour"),
        money.shown(hour * F.col(hours).cast("double")).alias("workload_usd"),
    )


def cheapest_region(regions: DataFrame) -> DataFrame:
    return regions.groupBy("provider").agg(
        F.min_by("region", F.struct("price_index", "region")).alias("region"),
        F.min("price_index").alias("price_index"),
    )


def compare_platforms(
    workloads: DataFrame, rates: DataFrame, prices: DataFrame, bands: DataFrame
) -> DataFrame:
    """All-in price per compute-unit hour of each workload against list prices elsewhere.

    ``workloads``: ``provider, plan, ccu_hours`` and any key columns.
    """
    keys = workloads.columns
    hour = F.expr(node_cost_sql(dims.UNIT_VCPUS, dims.UNIT_GB))
    rated = workloads.join(
        F.broadcast(rates.withColumnRenamed("provider", "_rp")), F.col("provider") == F.col("_rp")
    ).withColumn("infra_usd", money.amount(hour * F.col("ccu_hours").cast("double")))
    billed = platform_fees(rated, bands)
    all_in = money.part(F.col("infra_usd") + F.col("platform_fee_usd"), F.col("ccu_hours"))
    ours = billed.withColumn("all_in_usd_per_ccu_hour", all_in)
    return ours.crossJoin(F.broadcast(prices)).select(
        *keys,
        "platform",
        F.col("all_in_usd_per_ccu_hour").cast("decimal(18,5)").alias("all_in_usd_per_ccu_hour"),
        money.shown(F.col("usd_per_ccu_hour") * F.col("ccu_hours").cast("double")).alias("platform_usd"),
        F.when(
            F.col("all_in_usd_per_ccu_hour") > 0,
            (F.col("usd_per_ccu_hour") / F.col("all_in_usd_per_ccu_hour")).cast("decimal(18,1)"),
        ).alias("cheaper_by"),
    )


def query_costs(
    queries: DataFrame, rates: DataFrame, indexes: DataFrame, bands: DataFrame
) -> DataFrame:
    """Cost of each query before it runs: ``ccu_minutes, provider, region, plan, spot``.

    The fee uses the rate of the plan's first band.
    """
    by_plan = F.broadcast(band_arrays(bands))
    per_minute = f"({node_cost_sql(dims.UNIT_VCPUS, dims.UNIT_GB, 'spot')} / 60.0D)"
    first = marginal_rate_sql("0")
    return priced_rates(queries, rates, indexes).join(by_plan, "plan", "left").selectExpr(
        *queries.columns,
        f"CAST(CAST(ccu_minutes AS DOUBLE) * {per_minute} AS {money.AMOUNT}) AS infrastructure_usd",
        f"CAST(infrastructure_usd * {first} AS {money.AMOUNT}) AS fee_usd",
        f"CAST(infrastructure_usd * (1 + {first}) AS {money.AMOUNT}) AS total_usd",
    )


# --------------------------------------------------------- baseline and forecast


def efficiency_baseline(daily: DataFrame, days: int = 30) -> DataFrame:
    """Compute minutes per GB over the ``days`` before each day, per tenant.

    ``daily`` has one row per tenant and day, ``ccu_minutes`` and ``gb_scanned``,
    so a window over it is as long as the calendar, however busy the tenant.
    """
    day = F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("tenant_id").orderBy(day).rangeBetween(-days, -1)
    minutes, scanned = F.sum("ccu_minutes").over(before), F.sum("gb_scanned").over(before)
    return daily.select(
        "tenant_id",
        "day",
        "ccu_minutes",
        "gb_scanned",
        F.when(scanned > 0, money.part(minutes, scanned)).alias("baseline_ccu_per_gb"),
    )


def forecast(bills: DataFrame, as_of: Column) -> DataFrame:
    """Bill to date, drawn in a straight line to the end of the month of ``as_of``."""
    start = month_start(as_of)
    total = F.unix_micros(month_end(as_of)) - F.unix_micros(start)
    elapsed = F.greatest(F.unix_micros(as_of) - F.unix_micros(start), F.lit(1_000_000))
    projected = F.col("total_usd").cast("double") * (total.cast("double") / elapsed.cast("double"))
    return bills.filter(F.col("period_start") == start).select(
        *BILL_KEYS,
        (elapsed.cast("double") / total.cast("double")).cast("decimal(9,4)").alias("elapsed_fraction"),
        money.shown(F.col("total_usd")).alias("to_date_usd"),
        money.shown(projected).alias("projected_usd"),
        money.shown(F.col("infrastructure_usd")).alias("infrastructure_to_date_usd"),
        money.shown(F.col("platform_fee_usd")).alias("platform_fee_to_date_usd"),
    )


def invoices(
    bills: DataFrame, balances: DataFrame, issued_at: Column, net_days: int = 30
) -> DataFrame:
    """Monthly invoices with prepaid credit spent on the oldest month first.

    ``bills`` are priced without credits; ``balances`` is ``tenant_id,
    balance_usd``.  What a month gets is the growth of min(balance, payable so
    far), so no month has to wait for the one before it.
    """
    payable = money.positive(F.col("subtotal_usd") + F.col("commitment_usd"))
    owed = bills.withColumn("payable_usd", money.amount(payable))
    summed = running_total(owed, ["tenant_id", "plan"], ["period_start"], "payable_usd", "payable_so_far", [F.date_trunc("year", "period_start")])
    balance = money.amount(F.coalesce(F.col("balance_usd"), F.lit(0)))
    upto = F.least(balance, money.amount(F.col("payable_so_far")))
    before = F.least(balance, money.amount(F.col("payable_so_far") - F.col("payable_usd")))
    digest = F.upper(F.substring(F.md5(F.concat_ws("/", "tenant_id", "plan")), 1, 8))
    return summed.join(balances, "tenant_id", "left").select(
        *BILL_KEYS,
        F.concat(F.lit("INV-"), F.date_format("period_start", "yyyyMM"), F.lit("-"), digest).alias("number"),
        issued_at.alias("issued_at"),
        (issued_at + F.make_dt_interval(days=F.lit(net_days))).alias("due_at"),
        F.col("payable_usd"),
        money.amount(upto - before).alias("credits_applied_usd"),
        money.amount(F.col("payable_usd") - (upto - before)).alias("amount_due_usd"),
    )
