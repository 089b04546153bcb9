"""Decimal types of quantities, rates and amounts.

Sums of decimals do not depend on the order in which tasks finish, so a bill is
the same on every run and every cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = "decimal(20,9)"
RATE = "decimal(16,12)"
#: Amounts while a bill is worked out, and as they are shown.
AMOUNT = "decimal(24,8)"
SHOWN = "decimal(18,4)"

GB = 1_000_000_000


def quantity(column: Column) -> Column:
    return column.cast(QUANTITY)


def rate(column: Column) -> Column:
    return column.cast(RATE)


def amount(column: Column) -> Column:
    return column.cast(AMOUNT)


def shown(column: Column) -> Column:
    return column.cast(SHOWN)


def part(total: Column, by: Column | float) -> Column:
    """A quotient as a double; NULL-free when the divisor is zero."""
    divisor = by if isinstance(by, Column) else F.lit(float(by))
    return F.when(divisor != 0, total.cast("double") / divisor.cast("double")).otherwise(F.lit(0.0))


def positive(column: Column) -> Column:
    """The column, or zero when it is negative."""
    return F.greatest(column, F.lit(0).cast("int"))
