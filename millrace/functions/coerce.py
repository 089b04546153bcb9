"""Reading a value of one type as another.

``coerce`` gives NULL where a value does not fit; ``is_bad`` tells such a cell
from a missing one, so the caller can fail, null or set the row aside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import NUMBER_PATTERN, WHOLE_PATTERN, number_text
from millrace.schema import kind_of

#: Numbers above this are epoch milliseconds, not seconds (fixed value).
MILLIS_ABOVE = 1e11

#: A full calendar date must start the text; ``2026`` alone is no date.
ISO_DATE = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ].*)?$"

_NUMERIC = {"int", "long", "float", "double", "decimal"}


def from_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds to an instant."""
    value = number.cast("double")
    micros = F.when(value > MILLIS_ABOVE, value * 1e3).otherwise(value * 1e6)
    return F.timestamp_micros(F.round(micros).cast("bigint"))


def _iso(text: Column, target: str) -> Column:
    return F.when(text.rlike(ISO_DATE), F.btrim(text).try_cast(target))


def to_instant(value: Column, kind: str) -> Column:
    """A point in time; text without an offset is UTC."""
    if kind == "string":
        return _iso(value, "timestamp")
    if kind in _NUMERIC:
        return from_epoch(value)
    if kind in ("date", "timestamp", "timestamptz"):
        return value.cast("timestamp")
    return F.lit(None).cast("timestamp")


def to_wall_time(value: Column, kind: str) -> Column:
    """A time without zone: an offset in the text is dropped, not applied."""
    if kind == "string":
        return _iso(value, "timestamp_ntz")
    return to_instant(value, kind).cast("timestamp_ntz")


def to_date(value: Column, kind: str) -> Column:
    if kind == "string":
        return _iso(value, "timestamp_ntz").cast("date")
    if kind in ("date", "timestamp", "timestamptz"):
        return value.cast("date")
    return F.lit(None).cast("date")


def to_time(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.replace(value, F.lit("Z"), F.lit("")).try_cast("time(6)")
    if kind in ("time", "timestamp", "timestamptz"):
        return value.cast("time(6)")
    return F.lit(None).cast("time(6)")


def to_whole(value: Column, kind: str, target: str) -> Column:
    """Truncating; whole text is read exactly, never through a double."""
    if kind == "string":
        # A failing cast is slow, so a text is cast only when its shape fits.
        text = F.btrim(value)
        truncated = text.try_cast("double").try_cast("bigint")
        return (
            F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text.cast("bigint"))
            .when(text.rlike(WHOLE_PATTERN), F.coalesce(text.try_cast("bigint"), truncated))
            .when(F.lower(text).rlike(NUMBER_PATTERN), truncated)
            .try_cast(target)
        )
    if kind == "boolean" or kind in _NUMERIC:
        return value.try_cast("bigint").try_cast(target) if kind != "long" else value.try_cast(target)
    return F.lit(None).cast(target)


def to_float(value: Column, kind: str, target: str) -> Column:
    if kind == "string":
        plain = number_text(F.btrim(value))
        return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast(target))
    if kind == "boolean" or kind in _NUMERIC:
        return value.cast(target)
    return F.lit(None).cast(target)


def to_decimal(value: Column, kind: str, target: T.DecimalType) -> Column:
    """Rounded half to even at the scale of the column, whatever digits stand before the point.

    The cast rounds half away from zero; only exact ties behind an even digit
    differ, and those are seen in the text.  Text with an exponent is rounded
    on a finer scale where that has room.
    """
    if kind not in _NUMERIC and kind != "string":
        return F.lit(None).cast(target)
    text = F.btrim(value) if kind == "string" else value.try_cast("string")
    scale, wide = target.scale, T.DecimalType(38, target.scale)
    fine = F.bround(text.try_cast(T.DecimalType(38, min(38, 2 * scale + 2))), scale).try_cast(wide)
    kept = f"[0-9]*\\.[0-9]{{{scale - 1}}}[02468]" if scale else "[0-9]*[02468]\\.|\\."
    tie = f"^([+-]?(?:{kept}))50*$"
    even = F.concat(F.regexp_extract(text, tie, 1), F.lit("0")).try_cast(wide)
    plain = F.when(text.rlike(tie), even).otherwise(text.try_cast(wide))
    return F.when(text.rlike("[eE]"), F.coalesce(fine, text.try_cast(wide))).otherwise(plain).try_cast(target)


def to_boolean(value: Column, kind: str) -> Column:
    """Truth words (t, true, yes, y, 1 and their opposites) or number != 0."""
    if kind in ("string", "boolean"):
        return value.try_cast("boolean")
    if kind in _NUMERIC:
        return value != 0
    return F.lit(None).cast("boolean")


def to_text(value: Column, kind: str, source: T.DataType) -> Column:
    """Nested values as JSON, scalars as text, truth values capitalised."""
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(value)
    if kind == "boolean":
        return F.initcap(value.cast("string"))
    return value.cast("string")


def coerce(value: Column, source: T.StructField | T.DataType, target: T.StructField) -> Column:
    """``value`` read as the type of ``target``, NULL where that is impossible."""
    have, want = kind_of(source), kind_of(target)
    source_type = source.dataType if isinstance(source, T.StructField) else source
    # A JSON text column is plain text to every reader.
    read = "string" if have == "json" and isinstance(source_type, T.StringType) else have
    if source_type == target.dataType:
        return value
    if want in ("json", "string"):
        return to_text(value, read, source_type)
    if want == "timestamptz":
        out = to_instant(value, read)
    elif want == "timestamp":
        out = to_wall_time(value, read)
    elif want == "date":
        out = to_date(value, read)
    elif want == "time":
        out = to_time(value, read)
    elif want in ("int", "long"):
        out = to_whole(value, read, "int" if want == "int" else "bigint")
    elif want in ("float", "double"):
        out = to_float(value, read, want)
    elif want == "decimal":
        out = to_decimal(value, read, target.dataType)
    elif want == "boolean":
        out = to_boolean(value, read)
    elif want == "binary":
        out = F.encode(value, "utf-8") if read == "string" else F.lit(None).cast("binary")
    else:
        out = value
    return out


def is_bad(value: Column, coerced: Column) -> Column:
    """A present value that did not fit."""
    return value.isNotNull() & coerced.isNull()
