import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from millrace import dims
from millrace.usage import credits as C
from millrace.usage import pricing as P
from millrace.usage import quotas as Q
from millrace.usage import sizing

from .conftest import rows

MONTH = dt.datetime(2026, 1, 1)
SUMMARY = (
    "tenant_id string, period_start timestamp_ntz, meter string, quantity decimal(20,9), infra_cost_usd decimal(24,8)"
)


@pytest.fixture(scope="module")
def card(spark):
    return P.RateCard.default(spark)


def summary(spark, usage, tenant="t"):
    return spark.createDataFrame([(tenant, MONTH, m, D(str(q)), D(str(c))) for m, q, c in usage], SUMMARY)


def account(spark, plan, **more):
    kinds = {"term_months": "int", "credits_balance_usd": "double", "baseline_ccu_per_gb": "double", "gb_scanned": "double"}
    ddl = "tenant_id string, plan string" + "".join(f", {k} {kinds[k]}" for k in more)
    return spark.createDataFrame([("t", plan, *more.values())], ddl)


def bill(spark, card, usage, plan="team", **more):
    return P.price(summary(spark, usage), account(spark, plan, **more), card).first()


def usd(value):
    return float(round(value, 4))


@pytest.mark.parametrize("plan,spend,fee", [("team", 2000, 600), ("team", 3000, 820), ("team", 30000, 5360),
                                            ("team", 60000, 9360), ("business", 60000, 8100), ("enterprise", 100, 8),
                                            ("trial", 5000, 0), ("community", 5000, 0)])
def test_progressive_fee(spark, plan, spend, fee):
    df = spark.createDataFrame([(plan, D(spend))], "plan string, infra_usd decimal(24,8)")
    row = P.platform_fees(df, dims.fee_bands(spark)).first()
    assert usd(row.platform_fee_usd) == fee and float(row.blended_rate) == pytest.approx(fee / spend, abs=1e-6)


def test_fee_never_falls_as_spend_grows(spark):
    df = spark.range(0, 70000, 500).selectExpr("'team' AS plan", "id", "CAST(id AS DECIMAL(24,8)) AS infra_usd")
    fees = [r.platform_fee_usd for r in P.platform_fees(df, dims.fee_bands(spark)).orderBy("id").collect()]
    assert fees == sorted(fees)


WORKED = [(dims.COMPUTE, 72000, "37.08"), (dims.STORAGE, 3000, "41.4"), (dims.INGEST, 400, "0.0048"), (dims.TASKS, 3000, "1.315")]


def test_worked_bill(spark, card):
    row = bill(spark, card, WORKED)
    assert [usd(row[c]) for c in ("infrastructure_usd", "fee_usd", "addons_usd", "minimum_usd", "total_usd")] == [
        79.7998, 23.9399, 6.0, 69.0601, 178.7998,
    ]
    assert float(row.effective_markup) == 2.241


def test_addon_above_the_allowance(spark, card):
    row = bill(spark, card, [(dims.INGEST, 150, "1")])
    line = [u for u in row.usage_lines if u.meter == dims.INGEST][0]
    assert usd(line.addon_quantity) == 50 and usd(row.addons_usd) == 1
    assert usd(bill(spark, card, [(dims.INGEST, 150, "1")], "enterprise").addons_usd) == 0


def test_commitment_and_minimum(spark, card):
    row = bill(spark, card, [(dims.EGRESS, 1, "100")], "business", term_months=36)
    assert usd(row.commitment_usd) == -5 and usd(row.minimum_usd) == 984 and row.total_usd >= 999
    large = [(dims.EGRESS, 1, "100000")]
    assert usd(bill(spark, card, large, "business", term_months=12).commitment_usd) == usd(D("-0.15") * 11700)
    assert usd(bill(spark, card, large, "business", term_months=35).commitment_usd) == usd(D("-0.15") * 11700)
    assert usd(bill(spark, card, large, "trial", term_months=36).commitment_usd) == 0


def test_credits_never_make_a_bill_negative(spark, card):
    row = bill(spark, card, WORKED, credits_balance_usd=1e6)
    assert row.total_usd == 0 and usd(row.credits_usd) == -178.7998
    assert usd(bill(spark, card, WORKED, credits_balance_usd=100.0).total_usd) == 78.7998


def test_dividend_is_capped_and_one_directional(spark, card):
    usage = [(dims.COMPUTE, 1000, "100")]
    small = bill(spark, card, usage, baseline_ccu_per_gb=11.0, gb_scanned=100.0)
    assert usd(small.saved_usd) == 10 and usd(small.success_fee_usd) == 3
    huge = bill(spark, card, usage, baseline_ccu_per_gb=1e6, gb_scanned=100.0)
    assert huge.success_fee_usd == huge.fee_usd
    for worse in ({"baseline_ccu_per_gb": 1.0, "gb_scanned": 100.0}, {"baseline_ccu_per_gb": 11.0, "gb_scanned": 0.0},
                  {"baseline_ccu_per_gb": None, "gb_scanned": 5.0}):
        assert bill(spark, card, usage, **worse).success_fee_usd == 0


def test_lines_add_up_to_the_bill(spark, card):
    bills = P.price(summary(spark, WORKED), account(spark, "team", term_months=12, credits_balance_usd=20.0), card)
    lines = P.line_items(bills)
    kinds = [r.kind for r in lines.orderBy("seq", "meter").collect()]
    assert kinds == ["infrastructure"] * 4 + ["platform_fee", "addon", "discount", "minimum", "discount"]
    one, two = bills.first(), P.bill_totals(lines).first()
    for column in ("infrastructure_usd", "platform_fee_usd", "addons_usd", "discounts_usd", "subtotal_usd", "total_usd", "effective_markup"):
        assert one[column] == two[column]


def test_usage_without_cost_is_listed_and_markups_apply(spark):
    card = P.RateCard.default(spark, storage_markup=0.5)
    bills = P.price(summary(spark, [(dims.API, 5, 0), (dims.STORAGE, 1, 10), (dims.EGRESS, 0, 0)]), account(spark, "community"), card)
    found = rows(P.line_items(bills).select("meter", F.col("amount_usd").cast("double")))
    assert found == [(dims.API, 0.0), (dims.STORAGE, 15.0)]


def test_compare_plans_is_cheapest_first(spark, card):
    out = P.compare_plans(summary(spark, WORKED), account(spark, "team"), card).collect()
    assert [r.plan for r in out] == ["community", "trial", "team", "business", "enterprise"]
    totals = [r.total_usd for r in out]
    assert totals == sorted(totals)


def test_custom_rate_card(spark):
    bands = dims.fee_bands(spark, "('team', 0.0, NULL, 0.5)")
    card = P.RateCard.default(spark, bands=bands, commitments=dims.commitment_tiers(spark, "(6, 0.5)"))
    row = bill(spark, card, [(dims.EGRESS, 1, "1000")], term_months=6)
    assert usd(row.fee_usd) == 500 and usd(row.commitment_usd) == -250


def test_provider_and_platform_comparison(spark):
    shape = spark.createDataFrame([(8, 32, 1.0)], "vcpus int, gb_ram int, hours double")
    hour = {r.provider: float(r.usd_per_hour) for r in P.compare_providers(shape, dims.rates(spark)).collect()}
    assert hour == {"aws": 0.384, "azure": 0.384, "gcp": 0.3872, "tencent": 0.2472, "alibaba": 0.2768, "generic": 0.0456, "local": 0.0}
    work = spark.createDataFrame([("tencent", "team", 1000.0)], "provider string, plan string, ccu_hours double")
    out = P.compare_platforms(work, dims.rates(spark), dims.platform_prices(spark), dims.fee_bands(spark)).collect()
    assert {r.platform: float(r.cheaper_by) for r in out}["databricks_sql_serverless"] == 13.7
    assert float(out[0].all_in_usd_per_ccu_hour) == 0.04017
    best = {r.provider: r.region for r in P.cheapest_region(dims.regions(spark)).collect()}
    assert best["aws"] == "ap-south-1" and best["alibaba"] == "cn-hangzhou"


def test_query_cost_uses_the_first_band(spark):
    df = spark.createDataFrame([("tencent", None, "team", False, 100.0)], "provider string, region string, plan string, spot boolean, ccu_minutes double")
    row = P.query_costs(df, dims.rates(spark), dims.region_indexes(spark), dims.fee_bands(spark)).first()
    assert usd(row.infrastructure_usd) == 0.0515 and usd(row.fee_usd) == usd(D("0.01545"))


def test_baseline_excludes_the_day_itself(spark):
    days = [("t", dt.date(2026, 1, 1) + dt.timedelta(i), D(10 * (i + 1)), D(1)) for i in (0, 1, 30, 31)]
    df = spark.createDataFrame(days, "tenant_id string, day date, ccu_minutes decimal(18,2), gb_scanned decimal(18,2)")
    out = [r.baseline_ccu_per_gb for r in P.efficiency_baseline(df).orderBy("day").collect()]
    assert out == [None, 10.0, 15.0, pytest.approx((20 + 310) / 2)]


def test_forecast(spark, card):
    bills = P.price(summary(spark, WORKED), account(spark, "team"), card)
    as_of = F.lit(dt.datetime(2026, 1, 16, 12)).cast("timestamp")
    row = P.forecast(bills, as_of).first()
    assert float(row.elapsed_fraction) == 0.5 and float(row.projected_usd) == pytest.approx(357.5996)
    start = P.forecast(bills, F.lit(MONTH).cast("timestamp")).first()
    assert float(start.projected_usd) == pytest.approx(178.7998 * 31 * 86400, rel=1e-6)


def test_invoices_spend_credit_on_the_oldest_month(spark, card):
    months = [dt.datetime(2026, m, 1) for m in (1, 2, 3)]
    use = spark.createDataFrame([("t", m, dims.EGRESS, D(1), D(1000)) for m in months], SUMMARY)
    bills = P.price(use, account(spark, "community"), card)
    balances = spark.createDataFrame([("t", D(1500))], "tenant_id string, balance_usd decimal(24,8)")
    out = P.invoices(bills, balances, F.lit("2026-04-01").cast("timestamp_ntz")).orderBy("period_start").collect()
    assert [(usd(r.credits_applied_usd), usd(r.amount_due_usd)) for r in out] == [(1000, 0), (500, 500), (0, 1000)]
    assert out[0].due_at == dt.datetime(2026, 5, 1) and out[0].number.startswith("INV-202601-")


# ---------------------------------------------------------------------- credits

DAY0 = dt.datetime(2026, 1, 1)


def grants(spark, *amounts_and_days):
    data = [(f"g{i}", "t", D(a), D(0), D(0), DAY0 + dt.timedelta(i), DAY0 + dt.timedelta(d) if d else None)
            for i, (a, d) in enumerate(amounts_and_days)]
    return spark.createDataFrame(data, "grant_id string, tenant_id string, purchased_usd decimal(24,8), bonus_usd decimal(24,8), "
                                       "consumed_usd decimal(24,8), granted_at timestamp_ntz, expires_at timestamp_ntz")


def charges(spark, *amounts):
    return spark.createDataFrame([("t", f"c{i:04d}", DAY0 + dt.timedelta(i), D(a)) for i, a in enumerate(amounts)],
                                 "tenant_id string, charge_id string, charged_at timestamp_ntz, amount_usd decimal(24,8)")


NOW = F.lit


def as_of(days):
    return F.lit(DAY0 + dt.timedelta(days)).cast("timestamp_ntz")


def test_purchase_bonus(spark):
    buys = spark.createDataFrame([(str(a), "t", float(a), DAY0) for a in (1000, 10000, 100000, 0, -5)],
                                 "grant_id string, tenant_id string, purchased_usd double, granted_at timestamp_ntz")
    out = {r.grant_id: usd(r.bonus_usd) for r in C.grant_credits(buys, dims.credit_tiers(spark)).collect()}
    assert out == {"1000": 0, "10000": 500, "100000": 15000}


def test_oldest_expiry_is_spent_first(spark):
    held = grants(spark, (100, 365), (100, 30))
    out = C.burn_credits(held, charges(spark, 120), as_of(5))
    assert [(r.grant_id, usd(r.burned_usd)) for r in out.orderBy("grant_id").collect()] == [("g0", 20), ("g1", 100)]
    left = {r.grant_id: usd(r.remaining_usd) for r in C.consumed(out, held).collect()}
    assert left == {"g0": 80, "g1": 0}


def test_spending_more_than_there_is(spark):
    out = C.burn_credits(grants(spark, (50, None)), charges(spark, 500), as_of(5))
    assert [usd(r.burned_usd) for r in out.collect()] == [50]
    assert C.burn_credits(grants(spark, (50, 3)), charges(spark, 5), as_of(3)).count() == 0


def test_balance(spark):
    held = grants(spark, (100, 30), (40, None), (7, 10))
    assert [usd(r.balance_usd) for r in C.credit_balance(held, as_of(10)).collect()] == [140]


def burn_by_hand(held, spent):
    out, held = {}, [list(g) for g in held]
    for charge, amount in spent:
        for g in held:
            take = min(g[1], amount)
            if take > 0:
                out[g[0], charge] = take
                g[1] -= take
                amount -= take
    return out


@pytest.mark.parametrize(
    "periods,steps", [(("year",), (10**6,)), (("month", "day"), (1000, 10)), (("year", "month", "minute"), (500, 50, 1))]
)
def test_burning_many_charges_matches_one_by_one(spark, periods, steps):
    credit = [((i * 37) % 90 + 10, 200 + i) for i in range(60)]
    spent = [(i * 53) % 40 for i in range(150)]
    found = C.burn_credits(grants(spark, *credit), charges(spark, *spent), as_of(1), periods, steps)
    wanted = burn_by_hand([(f"g{i}", a) for i, (a, _) in enumerate(credit)], [(f"c{i:04d}", a) for i, a in enumerate(spent)])
    assert {(r.grant_id, r.charge_id): int(r.burned_usd) for r in found.collect()} == wanted


# ----------------------------------------------------------------------- quotas


@pytest.fixture(scope="module")
def limits(spark):
    return Q.effective_limits(dims.plans(spark), dims.free_tiers(spark))


def test_effective_limits(limits):
    found = {(r.plan, r.provider): r for r in limits.collect()}
    assert len(found) == 35
    aws, tencent = found["trial", "aws"], found["trial", "tencent"]
    assert (aws.daily_ccu_minutes, aws.monthly_ccu_minutes, aws.storage_gb, aws.monthly_ingest_gb) == (375, 11250, 5, 5)
    assert (tencent.daily_ccu_minutes, tencent.storage_gb, tencent.monthly_ingest_gb) == (0, 50, 5)
    assert found["trial", "gcp"].monthly_ccu_minutes == 11160
    local = found["trial", "local"]
    assert (local.daily_ccu_minutes, local.storage_gb, local.monthly_ingest_gb) == (None, None, None)
    assert found["trial", "generic"].storage_gb == 5 and found["team", "aws"].daily_ccu_minutes is None
    assert local.daily_task_minutes == 60


def report(spark, limits, usage, plan="trial", provider="aws", ask=0, now=dt.datetime(2026, 1, 16, 12)):
    data = [("t", m, D(str(q)), at) for m, q, at in usage] or [("other", dims.API, D(1), MONTH)]
    events = spark.createDataFrame(data, "tenant_id string, meter string, quantity decimal(20,9), occurred_at timestamp_ntz")
    accounts = spark.createDataFrame([("t", plan, provider)], "tenant_id string, plan string, provider string")
    asks = spark.createDataFrame([("t", float(ask))], "tenant_id string, daily_ccu_minutes double")
    out = Q.quota_report(events, accounts, limits, F.lit(now).cast("timestamp"), asks)
    return {r.limit_name: r for r in out.collect()}


def test_quota_at_and_over_the_limit(spark, limits):
    today, before = dt.datetime(2026, 1, 16, 3), dt.datetime(2026, 1, 15, 3)
    exact = report(spark, limits, [(dims.COMPUTE, 300, today), (dims.COMPUTE, 1000, before)], ask=75)
    assert exact["daily_ccu_minutes"].allowed and float(exact["daily_ccu_minutes"].remaining) == 75
    assert float(exact["daily_ccu_minutes"].utilization) == 0.8
    assert float(exact["monthly_ccu_minutes"].used) == 1300
    over = report(spark, limits, [(dims.COMPUTE, 300, today)], ask=75.5)
    assert not over["daily_ccu_minutes"].allowed and over["monthly_ccu_minutes"].allowed


def test_quota_without_usage_or_limit(spark, limits):
    none = report(spark, limits, [], provider="tencent")
    assert none["daily_ccu_minutes"].allowed and float(none["daily_ccu_minutes"].utilization) == 0
    free = report(spark, limits, [(dims.COMPUTE, 1e6, dt.datetime(2026, 1, 16))], plan="team")
    assert free["daily_ccu_minutes"].allowed and free["daily_ccu_minutes"].remaining is None


def test_storage_quota_turns_gb_months_back_into_gb(spark, limits):
    half = report(spark, limits, [(dims.STORAGE, 3, dt.datetime(2026, 1, 2))])
    assert float(half["storage_gb"].used) == 6 and not half["storage_gb"].allowed
    early = report(spark, limits, [(dims.INGEST, 6, MONTH)], now=MONTH)
    assert not early["monthly_ingest_gb"].allowed and float(early["storage_gb"].used) == 0


def test_first_refusal_and_warehouse_limits(spark, limits):
    accounts = spark.createDataFrame([("t", "trial", "aws"), ("u", "team", "aws")], "tenant_id string, plan string, provider string")
    houses = spark.createDataFrame([("t", "w1", "XL"), ("u", "w2", "4xl")], "tenant_id string, warehouse_id string, size string")
    out = {(r.tenant_id, r.limit_name): r.allowed for r in Q.warehouse_checks(houses, accounts, limits, dims.sizes(spark)).collect()}
    assert out == {("t", "max_warehouse_size"): False, ("t", "max_warehouses"): False,
                   ("u", "max_warehouse_size"): True, ("u", "max_warehouses"): True}


def test_budget(spark, card):
    bills = P.price(summary(spark, WORKED), account(spark, "team"), card)
    caps = spark.createDataFrame([("t", D(180), D(5))], "tenant_id string, cap_usd decimal(18,2), asked_usd decimal(18,2)")
    assert [float(r.projected_usd) for r in Q.budget_breaches(bills, caps).collect()] == [183.7998]
    assert Q.budget_breaches(bills, caps.drop("asked_usd")).count() == 0


def test_sizes(spark):
    found = {r.size: (r.vcpus, r.ccu_per_minute) for r in dims.sizes(spark).collect()}
    assert found["xs"] == (2, 2) and found["m"] == (8, 8) and found["4xl"] == (256, 256)
    scans = spark.createDataFrame([(0,), (10**9,), (3600 * 2 * 10**6,), (3600 * 2 * 10**6 + 10**6,), (10**15,)], "bytes_scanned bigint")
    out = sizing.recommend_sizes(scans, dims.sizes(spark)).orderBy("bytes_scanned").collect()
    assert [r.recommended_size for r in out] == ["xs", "xs", "xs", "s", "4xl"]
    house = spark.createDataFrame([("m", "tencent", None, False, 2, 0.01)], "size string, provider string, region string, spot boolean, min_clusters int, unit_price_usd double")
    row = sizing.size_costs(house, dims.sizes(spark), dims.rates(spark), dims.region_indexes(spark)).first()
    assert (float(row.infra_usd_per_hour), row.ccu_per_hour, float(row.total_usd_per_hour)) == (0.4944, 960, 10.0944)


def test_usage_without_a_bill_is_listed(spark, card):
    known, lost, odd = (summary(spark, [(dims.COMPUTE, 60, 3)], t) for t in ("t", "lost", "odd"))
    accounts = spark.createDataFrame([("t", "team"), ("odd", "platinum")], "tenant_id string, plan string")
    usage = known.unionAll(lost).unionAll(odd)
    assert [r.tenant_id for r in P.price(usage, accounts, card).collect()] == ["t"]
    found = P.unbilled_usage(usage, accounts, card)
    assert rows(found.select("tenant_id", "quantity", "reason")) == [
        ("lost", D(60), "no account"), ("odd", D(60), "unknown plan")]
