"""Keyed merges: last write wins inside a batch, batch over target.

Order inside a DataFrame means nothing, so the caller names the columns that
say which record is newer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return False
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    return True


def last_wins(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One record per key: the one with the highest ``order_by``.

    An aggregate instead of a ranking window, so every task first reduces its
    own rows and a key that holds much of the batch never lands in one task.
    Equal ``order_by`` values are settled by the other columns, which makes the
    result the same under any partitioning.
    """
    rest = [
        f.name
        for f in batch.schema.fields
        if f.name not in keys and f.name not in order_by and _orderable(f.dataType)
    ]
    newest = F.struct(*[F.col(f"`{c}`") for c in [*order_by, *rest]])
    values = [c for c in batch.columns if c not in keys]
    if not values:
        return batch.dropDuplicates(list(keys))
    if len(order_by) + len(rest) == len(values):
        kept = F.max(newest)  # the order holds all there is, so nothing travels twice
    else:
        kept = F.max_by(F.struct(*[F.col(f"`{c}`") for c in values]), newest)
    grouped = batch.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(kept.alias("_row"))
    return grouped.select(
        *[
            F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c)
            for c in batch.columns
        ]
    )


def merge_frames(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    null_safe: bool = True,
) -> DataFrame:
    """The target after a keyed write of ``batch``.

    ``null_safe=True`` is the upsert: NULL keys are equal to each other.
    ``null_safe=False`` follows SQL MERGE: a NULL key never matches, so such
    records are always inserted, and a table that is all key only gains rows.
    Without keys the batch is appended.

    The target is filtered by an anti join against the distinct incoming keys;
    only keys travel for that, and AQE broadcasts them when they turn out small.
    """
    if not keys:
        return target.unionByName(batch, allowMissingColumns=True)
    if null_safe:
        incoming = last_wins(batch, keys, order_by)
        in_keys = _renamed_keys(incoming, keys)
    else:
        keyed = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        newest = last_wins(batch.filter(keyed), keys, order_by)
        incoming = newest.unionByName(batch.filter(~keyed))
        in_keys = _renamed_keys(newest, keys)
        if set(target.columns) == set(keys):
            # Nothing but keys: a matched row has nothing to update.
            fresh = incoming.join(
                _renamed_keys(target, keys), _keys_match(keys, null_safe), "left_anti"
            )
            return target.unionByName(fresh)
    kept = target.join(in_keys, _keys_match(keys, null_safe), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def touched(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target's rows whose key is in the batch; NULL keys are equal to each other."""
    return target.join(_renamed_keys(batch, keys), _keys_match(keys, True), "left_semi")


def _renamed_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys under other names: the batch may be derived from the target."""
    return df.select(*[F.col(f"`{k}`").alias(f"_in_{k}") for k in keys])


def _keys_match(keys: Sequence[str], null_safe: bool) -> Column:
    sign = "<=>" if null_safe else "="
    return F.expr(" AND ".join(f"`{k}` {sign} `_in_{k}`" for k in keys))


def since(
    df: DataFrame, cursor: str, last: object | None, inclusive: bool = True
) -> DataFrame:
    """Rows at or after (or strictly after) a checkpoint; all rows without one.

    The comparison is in the cursor's own type and reaches the scan.
    """
    if last is None:
        return df
    column = F.col(f"`{cursor}`")
    bound = F.lit(last).cast(df.schema[cursor].dataType)
    return df.filter(column >= bound if inclusive else column > bound)


def cursor_text(value: Column, kind: T.DataType) -> Column:
    """A cursor value as text that casts back to the same value in any session's or driver's zone."""
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return value.cast("string")


def high_water(df: DataFrame, cursor: str) -> DataFrame:
    """The highest cursor seen, with its type name; NULL cursors do not count."""
    return df.agg(F.max(F.col(f"`{cursor}`")).alias("cursor_value")).select(
        F.lit(cursor).alias("cursor_column"),
        F.lit(df.schema[cursor].dataType.simpleString()).alias("cursor_type"),
        "cursor_value",
    )
