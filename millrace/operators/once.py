"""Computing expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later filters and selects will not compute again.

    Spark moves a filter below the select that defines its column by writing
    the column's expression into the filter, which then runs twice; chains of
    such columns multiply.  Unfolding a list of one row keeps them in place.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
