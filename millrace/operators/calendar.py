"""Firing times of schedules as rows, for backfills and missed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.once import computed_once

# Named schedules, the bounds of the five fields, month and day names.
NAMED = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
FIELDS = ["minutes", "hours", "days", "months", "weekdays"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]

_EVERY = r"^every\s+([0-9]+)?\s*(minute|hour|day)s?$"
_PART = r"^(\*|\?|[0-9]+(-[0-9]+)?)(/0*[1-9][0-9]*)?$"


def _five_fields(expression: Column) -> Column:
    """The expression as five fields: names and ``every N units`` are written out."""
    text = F.lower(F.trim(expression))
    count = F.coalesce(F.nullif(F.regexp_extract(text, _EVERY, 1), F.lit("")), F.lit("1"))
    unit = F.regexp_extract(text, _EVERY, 2)
    # Beyond 59 minutes the text has no five-field form; it stays malformed.
    minutes = (unit == "minute") & (count.try_cast("int") < 60)
    out = F.when(minutes, F.concat(F.lit("*/"), count, F.lit(" * * * *")))
    out = out.when(unit == "hour", F.concat(F.lit("0 */"), count, F.lit(" * * *")))
    out = out.when(unit == "day", F.concat(F.lit("0 0 */"), count, F.lit(" * *")))
    for name, written in NAMED.items():
        out = out.when(text == name, F.lit(written))
    return F.split(out.otherwise(text), r"\s+")


def _values(field: Column, index: int) -> Column:
    """The sorted numbers a field stands for; NULL when it is malformed."""
    low, high = BOUNDS[index]
    for number, name in enumerate(MONTHS if index == 3 else WEEKDAYS if index == 4 else []):
        field = F.regexp_replace(field, rf"\b{name}\b", str(number + (index == 3)))

    def expand(part: Column) -> Column:
        span = F.regexp_replace(part, "/.*$", "")
        step = F.nullif(F.regexp_extract(part, "/([0-9]+)$", 1), F.lit("")).cast("int")
        start = F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int")
        stop = F.nullif(F.split_part(span, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int")
        anything = span.isin("*", "?")
        first = F.when(anything, F.lit(low)).otherwise(start)
        # A start with a step runs to the end of the field.
        last = F.when(anything, F.lit(high)).otherwise(
            F.coalesce(stop, F.when(step > 1, F.lit(high)), start)
        )
        good = part.rlike(_PART) & (first <= last) & (first >= low) & (last <= high)
        return F.when(good, F.sequence(first, F.greatest(last, first), F.coalesce(step, F.lit(1))))

    parts = F.transform(F.split(field, ","), expand)
    numbers = F.flatten(parts)  # NULL as soon as one part is
    if index == 4:
        numbers = F.transform(numbers, lambda n: F.pmod(n, F.lit(7)))  # 7 is Sunday too
    return F.array_sort(F.array_distinct(numbers))


def parsed_schedules(schedules: DataFrame, expression: str = "cron") -> DataFrame:
    """Adds the number sets of the five fields, and whether the day fields are alternatives.

    ``valid`` is false for a malformed expression (wrong field count, value out
    of range, inverted range); its sets are NULL.  Every distinct expression is
    read once, however many schedules share it.
    """
    texts = schedules.select(F.col(f"`{expression}`").alias("_text")).distinct()
    fields = computed_once(texts, _fields=_five_fields(F.col("_text")))
    # A wrong number of fields makes every set NULL.
    five = F.size("_fields") == 5
    parts = computed_once(
        fields, **{f"_f{i}": F.when(five, F.get("_fields", F.lit(i))) for i in range(5)}
    )
    # Both day fields restricted: either may match.  ``?`` counts as ``*``.
    either = ~F.col("_f2").isin("*", "?") & ~F.col("_f4").isin("*", "?")
    sets = computed_once(
        parts,
        **{name: _values(F.col(f"_f{i}"), i) for i, name in enumerate(FIELDS)},
        either_day=either,
    )
    every = F.expr(" AND ".join(f"{name} IS NOT NULL" for name in FIELDS))
    parsed = sets.select("_text", *FIELDS, "either_day", every.alias("valid"))
    return schedules.join(
        parsed, F.col(f"`{expression}`").eqNullSafe(F.col("_text")), "left"
    ).drop("_text")


def firings(
    schedules: DataFrame,
    start: Column,
    end: Column,
    expression: str = "cron",
) -> DataFrame:
    """One row per schedule and firing in ``[start, end)``; both may differ per row.

    Only days that match are widened to their hours and minutes, so the work is
    the days covered plus the firings found.
    """
    keep = [F.col(f"`{c}`") for c in schedules.columns]
    bounded = parsed_schedules(schedules, expression).filter("valid").select(
        "*", start.cast("timestamp_ntz").alias("_start"), end.cast("timestamp_ntz").alias("_end")
    )
    days = bounded.filter("_start < _end").select(
        "*", F.explode(F.sequence(F.to_date("_start"), F.to_date("_end"))).alias("_day")
    )
    in_month = "array_contains(days, day(_day))"
    in_week = "array_contains(weekdays, dayofweek(_day) - 1)"
    matching = days.filter(
        "array_contains(months, month(_day)) AND "
        f"IF(either_day, {in_month} OR {in_week}, {in_month} AND {in_week})"
    )
    # All times of a day in one array, so a day is widened once.
    times = F.expr(
        "flatten(transform(hours, h -> transform(minutes, m -> "
        "CAST(_day AS TIMESTAMP_NTZ) + make_dt_interval(0, h, m, 0))))"
    )
    return (
        matching.select(*keep, "_start", "_end", F.explode(times).alias("fires_at"))
        .filter("fires_at >= _start AND fires_at < _end")
        .drop("_start", "_end")
    )


def due(
    schedules: DataFrame, runs: DataFrame, key: str, as_of: Column, run_at: str = "started_at",
    expression: str = "cron",
) -> DataFrame:
    """Per schedule: its last run and the first firing missed since, if any.

    A schedule that never ran is due when it fired in the hour up to ``as_of``.
    """
    last = runs.groupBy(key).agg(F.max(run_at).cast("timestamp_ntz").alias("last_run_at"))
    now = as_of.cast("timestamp_ntz")
    joined = schedules.join(last, key, "left")
    minute = F.expr("INTERVAL 1 MINUTE")
    # The first whole minute after the last run, and the minute of as_of itself.
    start = F.when(
        F.col("last_run_at").isNotNull(), F.date_trunc("minute", F.col("last_run_at")) + minute
    ).otherwise(F.date_trunc("minute", now) - F.expr("INTERVAL 59 MINUTES"))
    end = F.date_trunc("minute", now) + minute
    missed = (
        firings(joined, start, end, expression)
        .groupBy(key)
        .agg(F.min("fires_at").alias("due_since"), F.count(F.lit(1)).alias("missed"))
    )
    return joined.join(missed, key, "left").withColumn("is_due", F.col("due_since").isNotNull())
