"""Untyped text cells, as CSV files carry them.

A cell is trimmed, then is one of: nothing, a truth word, a whole number, a
number, or text.  A column gets one type from the kinds of all its cells
(``operators.infer``), and these helpers then read each cell as that type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that stand for a missing value, and the number shapes.
NULL_WORDS = ["", "null", "none", "n/a", "na"]
TRUTH_WORDS = ["true", "false"]
WHOLE_PATTERN = "^[+-]?[0-9]+$"
NUMBER_PATTERN = (
    r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
)

WHITESPACE = " \t\r\n\f\u000b"

#: Cell kinds, from the most to the least specific.
KINDS = ("null", "boolean", "whole", "number", "text")


def cell_text(raw: Column) -> Column:
    """The trimmed cell, or NULL for an empty cell and the null words."""
    text = F.btrim(raw, F.lit(WHITESPACE))
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def number_text(text: Column) -> Column:
    """Lower case, with underscores between digits removed (``1_000``)."""
    low = F.lower(text)
    return F.when(low.contains("_"), F.regexp_replace(low, "(?<=[0-9])_(?=[0-9])", "")).otherwise(low)


def text_kind(text: Column) -> Column:
    """Which of ``KINDS`` an already trimmed cell is."""
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(F.lower(text).isin(TRUTH_WORDS), F.lit("boolean"))
        .when(text.rlike(WHOLE_PATTERN), F.lit("whole"))
        .when(number_text(text).rlike(NUMBER_PATTERN), F.lit("number"))
        .otherwise(F.lit("text"))
    )


def cell_kind(raw: Column) -> Column:
    """Which of ``KINDS`` the cell is."""
    return text_kind(cell_text(raw))


def cell_boolean(raw: Column) -> Column:
    text = F.lower(cell_text(raw))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def cell_whole(raw: Column) -> Column:
    text = cell_text(raw)
    return F.when(text.rlike(WHOLE_PATTERN), text.try_cast("bigint"))


def cell_number(raw: Column) -> Column:
    text = number_text(cell_text(raw))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
