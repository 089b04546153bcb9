"""Running totals, carried values and idle sessions, scanned level by level.

A window over a whole group puts a hot group into one task.  Here the rows of a
group are cut into cells along its order, and cells into coarser ones: rows are
summed within their cell, cells within the coarser cell, and only the coarsest
ones across the group.  There is one plan for groups of every size, and nothing
is counted when it is made.

Totals are joined back by merging, since rows and cells are dealt by the same keys
and sizes guessed before the run can be far off (parsed messages seem a hundredth
of what they are), which would send all rows through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Timeouts in a slice of a resource's activity.
CELLS_PER_SLICE = 1024


def _earlier(by: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def before_cells(
    cells: DataFrame, by: Sequence[str], levels: Sequence[str], sums: Sequence[str] = (), lasts: Sequence[str] = ()
) -> DataFrame:
    """``by, levels`` and, for each value column, what the earlier cells of the group hold.

    ``cells`` has one row per cell; ``levels`` name its place from coarse to
    fine, and no finer place lies in two coarser ones.  A column of ``sums``
    becomes the sum over all earlier cells (0 before the first one), one of
    ``lasts`` the latest value that is not NULL.  No window holds more than the
    cells of one coarser cell, or the coarsest cells of one group.
    """
    *upper, finest = levels
    outer = [*by, *upper]
    along = _earlier(outer, finest)
    inside = {c: F.coalesce(F.sum(c).over(along), F.lit(0)) for c in sums}
    inside |= {c: F.last(c, ignorenulls=True).over(along) for c in lasts}
    if not upper:
        return cells.select(*by, finest, *[v.alias(c) for c, v in inside.items()])
    whole = cells.groupBy(*outer).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(finest))).alias(c) for c in lasts],
    )
    above = before_cells(whole, by, upper, sums, lasts).withColumnsRenamed({c: f"_up_{c}" for c in [*sums, *lasts]})
    placed = cells.select(*outer, finest, *[v.alias(c) for c, v in inside.items()]).join(above.hint("merge"), outer)
    return placed.select(
        *outer,
        finest,
        *[(F.col(c) + F.col(f"_up_{c}")).alias(c) for c in sums],
        *[F.coalesce(c, f"_up_{c}").alias(c) for c in lasts],
    )


def running_total(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], amount: str, out: str, levels: Sequence[Column]
) -> DataFrame:
    """``out`` = sum of ``amount`` over this and all earlier rows of the group.

    ``levels`` are expressions from coarse to fine, such as the month and the
    minute of the time that orders the rows.  They must not decrease along
    ``order_by``, and a finer value must lie in one coarser one.  Rows are added
    up within the finest one, so that is what a single task has to sort.
    Missing group and level values equal themselves and come first.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    keyed = df.select(
        "*",
        F.struct(*[F.col(f"`{c}`") for c in by]).alias("_key"),
        *[F.struct(level.alias("at")).alias(n) for n, level in zip(names, levels)],
    )
    cells = keyed.groupBy("_key", *names).agg(F.sum(amount).alias("_before"))
    before = before_cells(cells, ["_key"], names, sums=["_before"]).select("_key", names[-1], "_before")
    # Rows and cells are joined on the columns the window is split by: one shuffle serves both.
    inside = Window.partitionBy("_key", names[-1]).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    total = F.sum(amount).over(inside) + F.coalesce("_before", F.lit(0))
    return keyed.join(before.hint("merge"), ["_key", names[-1]]).select(*[F.col(f"`{c}`") for c in df.columns], total.alias(out))


def carried(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column], values: Mapping[str, Column], levels: Sequence[Column]
) -> DataFrame:
    """Each of ``values`` replaced by its latest one that is not NULL, up to this row.

    ``values`` maps new column names to the condition's value; ``levels`` are as in
    ``running_total``.  The group columns must not be NULL.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    rows = df.select(
        "*", *[level.alias(n) for n, level in zip(names, levels)], *[v.alias(f"_v_{c}") for c, v in values.items()]
    )
    newest = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    cells = rows.groupBy(*by, *names).agg(
        *[F.max_by(f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), newest)).alias(f"_b_{c}") for c in values]
    )
    before = before_cells(cells, by, names, lasts=[f"_b_{c}" for c in values]).drop(*names[:-1])
    inside = Window.partitionBy(*by, names[-1]).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return rows.join(before, [*by, names[-1]]).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.last(f"_v_{c}", ignorenulls=True).over(inside), F.col(f"_b_{c}")).alias(c) for c in values],
    )


def idle_sessions(df: DataFrame, by: Sequence[str], at: str, timeout_seconds: int) -> DataFrame:
    """Stretches of activity per resource: ``session, started_at, last_activity_at, activities``.

    A new stretch starts when the idle gap is the timeout or longer; 0 means
    never.  Activities are first combined inside each task into cells as long
    as the timeout: two of them in one cell are less than the timeout apart, so
    no gap is lost.  Cells are stitched within slices of ``CELLS_PER_SLICE``; a
    slice passes on its first and last activity and how many stretches begin in
    it, and slices are stitched in turn.  A resource with a third of all rows is
    spread over its slices.
    """
    ends = [
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count(F.lit(1)).alias("n"),
    ]
    known = df.filter(F.col(at).isNotNull()).withColumn("_key", F.struct(*[F.col(f"`{c}`") for c in by]))
    own = [F.col(f"_key.`{c}`").alias(c) for c in by]
    if timeout_seconds <= 0:
        return known.groupBy("_key").agg(*ends).select(
            *own,
            F.lit(1).cast("bigint").alias("session"),
            F.col("first_at").alias("started_at"),
            F.col("last_at").alias("last_activity_at"),
            F.col("n").alias("activities"),
        )
    width = timeout_seconds * 1_000_000

    def whole(a: Column, size: int) -> Column:
        return F.floor((a - F.pmod(a, F.lit(size))) / F.lit(size))

    def micros(name: str | Column) -> Column:
        return F.unix_micros((F.col(name) if isinstance(name, str) else name).cast("timestamp"))

    cell = whole(micros(at), width).alias("_cell")
    cells = known.groupBy("_key", cell).agg(*ends).withColumn("_slice", whole(F.col("_cell"), CELLS_PER_SLICE))

    # Inside a slice: does a cell begin a stretch?  The first one can't tell yet.
    along = Window.partitionBy("_key", "_slice").orderBy("_cell")
    gap = micros("first_at") - micros(F.lag("last_at").over(along))
    opens = F.when(gap >= width, 1).otherwise(0)
    placed = cells.withColumn("_opens", opens).withColumn(
        "_nth", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # Across slices: whether the first stretch of each goes on the last one before, and the stretches so far.
    slices = placed.groupBy("_key", "_slice").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("_opens").alias("_inside")
    )
    over = Window.partitionBy("_key").orderBy("_slice")
    between = micros("first_at") - micros(F.lag("last_at").over(over))
    begins = F.when(between < width, 0).otherwise(1)  # the first slice has none before
    numbered = slices.select("_key", "_slice", "_inside", begins.alias("_begins")).select(
        "_key",
        "_slice",
        (F.sum(F.col("_begins") + F.col("_inside")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")).alias(
            "_first"
        ),
    )
    joined = placed.join(numbered, ["_key", "_slice"]).withColumn("session", F.col("_first") + F.col("_nth"))
    return (
        joined.groupBy("_key", "session")
        .agg(F.min("first_at").alias("started_at"), F.max("last_at").alias("last_activity_at"), F.sum("n").alias("activities"))
        .select(*own, "session", "started_at", "last_activity_at", "activities")
    )
