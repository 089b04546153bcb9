"""Prepaid credit: bonus, balance and which charge burns which grant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.running import carried, running_total
from millrace.usage import money
from millrace.usage.pricing import best_tier_sql, tier_array

#: Sorts grants without an end after all others.
NEVER = "9999-12-31"


def grant_credits(purchases: DataFrame, tiers: DataFrame, expires_in_days: int | None = 365) -> DataFrame:
    """Purchases (``grant_id, tenant_id, purchased_usd, granted_at``) as grants with their bonus.

    A purchase must be positive; others give no grant.
    """
    one = F.broadcast(tier_array(tiers, "tiers"))
    usd = money.amount(F.col("purchased_usd"))
    rate = F.expr(best_tier_sql("purchased_usd", "tiers", "from_usd", "bonus"))
    expires = (
        F.col("granted_at") + F.make_dt_interval(days=F.lit(expires_in_days))
        if expires_in_days
        else F.lit(None).cast("timestamp")
    )
    return (
        purchases.filter(F.col("purchased_usd") > 0)
        .crossJoin(one)
        .select(
            "grant_id",
            "tenant_id",
            usd.alias("purchased_usd"),
            rate.alias("bonus_rate"),
            money.amount(usd * rate).alias("bonus_usd"),
            F.lit(0).cast(money.AMOUNT).alias("consumed_usd"),
            "granted_at",
            expires.alias("expires_at"),
        )
    )


def active_grants(grants: DataFrame, as_of: Column) -> DataFrame:
    """Grants that still hold credit at ``as_of``, with ``remaining_usd``."""
    left = money.amount(
        money.positive(F.col("purchased_usd") + F.col("bonus_usd") - F.col("consumed_usd"))
    )
    alive = F.col("expires_at").isNull() | (as_of < F.col("expires_at"))
    return grants.withColumn("remaining_usd", left).filter((F.col("remaining_usd") > 0) & alive)


def credit_balance(grants: DataFrame, as_of: Column) -> DataFrame:
    return (
        active_grants(grants, as_of)
        .groupBy("tenant_id")
        .agg(money.amount(F.sum("remaining_usd")).alias("balance_usd"))
    )


KINDS = ("_grant", "_charge")

#: Steps of the money axis, in USD, from coarse to fine: what lies in one fine step is merged in one task.
MONEY_STEPS = (10_000, 10)


def _stretches(frame: DataFrame, kind: str, periods: Sequence[str]) -> DataFrame:
    """Amounts laid end to end per tenant: ``tenant_id, _at, _grant, _charge``.

    A stretch is its end on the money axis and its id, and begins at ``_at``.
    """
    levels = [F.date_trunc(p, F.col("_when")) for p in periods]
    summed = running_total(frame, ["tenant_id"], ["_order"], "_usd", "_end", levels)
    ended = summed.select(
        "tenant_id", "_usd", F.struct(money.amount(F.col("_end")).alias("end"), F.col("_id").alias("id")).alias("_stretch")
    )
    return ended.select(
        "tenant_id",
        money.amount(F.col("_stretch.end") - F.col("_usd")).alias("_at"),
        *[F.when(F.lit(kind == k), F.col("_stretch")).alias(k) for k in KINDS],
    )


def burn_credits(
    grants: DataFrame,
    charges: DataFrame,
    as_of: Column,
    periods: Sequence[str] = ("month", "minute"),
    money_steps: Sequence[float] = MONEY_STEPS,
) -> DataFrame:
    """``tenant_id, grant_id, charge_id, burned_usd``: oldest credit first.

    Grants are spent by end date (none is last), then by grant date; charges by
    date.  Both are laid end to end on one money axis per tenant: a grant and a
    charge meet where their stretches overlap.  The stretches are merged along
    the axis instead of compared pair by pair, so the work and the output are
    linear in grants plus charges.

    Sums run level by level over ``periods`` (grants by their end date), and what
    is open at a place of the axis over ``money_steps``; both go from coarse to
    fine.  A tenant with a third of all rows is spread over its periods and steps.
    """
    expiry = F.coalesce(F.col("expires_at").cast("timestamp"), F.lit(NEVER).cast("timestamp"))
    credit = active_grants(grants, as_of).filter("tenant_id IS NOT NULL").select(
        "tenant_id",
        F.struct(expiry, F.col("granted_at"), F.col("grant_id")).alias("_order"),
        expiry.alias("_when"),
        F.col("grant_id").cast("string").alias("_id"),
        F.col("remaining_usd").alias("_usd"),
    )
    debt = charges.filter("amount_usd > 0 AND tenant_id IS NOT NULL").select(
        "tenant_id",
        F.struct("charged_at", "charge_id").alias("_order"),
        F.col("charged_at").alias("_when"),
        F.col("charge_id").cast("string").alias("_id"),
        money.amount(F.col("amount_usd")).alias("_usd"),
    )
    marks = _stretches(credit, "_grant", periods).unionByName(_stretches(debt, "_charge", periods))
    # What is open at a mark is the last of each kind to begin; at one place the
    # stretch that ends there comes before the one that begins.
    steps = [F.floor(F.col("_at") / F.lit(step).cast("decimal(18,8)")) for step in money_steps]
    open_at = {f"_open{k}": F.col(k) for k in KINDS}
    pieces = carried(marks, ["tenant_id"], ["_at", F.coalesce("_grant.end", "_charge.end")], open_at, steps)
    grant, charge = (F.col(name) for name in open_at)
    burned = money.amount(F.least(grant["end"], charge["end"]) - F.col("_at"))
    return (
        pieces.filter(grant.isNotNull() & charge.isNotNull())
        .select(
            "tenant_id",
            grant["id"].alias("grant_id"),
            charge["id"].alias("charge_id"),
            burned.alias("burned_usd"),
        )
        .filter(F.col("burned_usd") > 0)
    )


def consumed(burned: DataFrame, grants: DataFrame) -> DataFrame:
    """Grants after the burn: ``consumed_usd`` grown, ``remaining_usd`` what is left."""
    spent = burned.groupBy(F.col("grant_id").alias("_g")).agg(F.sum("burned_usd").alias("_spent"))
    joined = grants.join(spent, F.col("grant_id").cast("string") == F.col("_g"), "left")
    used = money.amount(F.col("consumed_usd") + F.coalesce(F.col("_spent"), F.lit(0)))
    left = F.col("purchased_usd") + F.col("bonus_usd") - F.col("consumed_usd")
    return (
        joined.withColumn("consumed_usd", used)
        .withColumn("remaining_usd", money.amount(money.positive(left)))
        .drop("_g", "_spent")
    )
