"""Calendar periods, ISO text and durations, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def month_end(ts: Column) -> Column:
    """First instant of the following month: periods are half open."""
    return F.date_trunc("month", ts) + F.expr("INTERVAL 1 MONTH")


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def day_end(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


def hours_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts)) * F.lit(24)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, never negative, to the microsecond."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(micros / F.lit(1e6), F.lit(0.0))


def to_iso(ts: Column) -> Column:
    """``2026-09-12T10:30:00Z``; a fraction is printed only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("Z"))


def from_iso(text: Column) -> Column:
    """ISO text to an instant; text without an offset is read as UTC."""
    return F.trim(text).try_cast("timestamp")


def format_duration(seconds: Column) -> Column:
    """``450ms``, ``1.2s``, ``3m 04s``, ``2h 07m``."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.format_string("%.0fms", seconds.cast("double") * 1000))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(
            seconds < 3600,
            F.format_string("%dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60))),
        )
        .otherwise(
            F.format_string(
                "%dh %02dm",
                F.floor(whole / 3600),
                F.floor(F.pmod(whole, F.lit(3600)) / 60),
            )
        )
    )


def human_bytes(size: Column) -> Column:
    """``512B``, ``1.5KB`` … in steps of 1024, ending at TB."""
    number = size.cast("double")
    out = F.when(F.abs(number) < 1024, F.concat(number.cast("bigint").cast("string"), F.lit("B")))
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        out = out.when(
            F.abs(number) < float(1024 ** (power + 1)),
            F.format_string(f"%.1f{unit}", number / float(1024**power)),
        )
    return out.otherwise(F.format_string("%.1fTB", number / float(1024**4)))
