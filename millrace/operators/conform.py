"""Inferring a schema from data and projecting data onto a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.functions import cells
from millrace.functions.coerce import coerce, is_bad
from millrace.schema import SchemaError

BAD_CELLS = "_bad_cells"
_BAD_TYPE = "array<struct<column:string,value:string>>"

#: Columns that inference makes of JSON keys at the most.
MAX_KEYS = 20_000

_INT_MIN, _INT_MAX = -(2**31), 2**31 - 1


# ----------------------------------------------------------------- inference


def cell_profile(df: DataFrame) -> DataFrame:
    """For every text column, how many cells there are of each kind.

    One pass: each task adds up ``columns × kinds`` counters and only those
    counters leave it.
    """
    numbered = list(enumerate(df.columns))
    # Trim, then classify, then count: each step once per cell.
    texts = df.select(
        *[cells.cell_text(F.col(f"`{name}`").cast("string")).alias(f"t{i}") for i, name in numbered]
    )
    kinds = texts.select(
        *[F.col(f"t{i}") for i, _ in numbered],
        *[cells.text_kind(F.col(f"t{i}")).alias(f"k{i}") for i, _ in numbered],
    )

    def counters(i: int, name: str) -> Column:
        kind, whole = F.col(f"k{i}"), F.col(f"t{i}").try_cast("bigint")
        # Inside a CASE, so that only whole numbers are cast at all.
        wide = F.when(
            kind == "whole", F.coalesce(~whole.between(_INT_MIN, _INT_MAX), F.lit(True))
        ).otherwise(F.lit(False))
        return F.struct(
            F.lit(name).alias("column"),
            *[F.sum((kind == k).cast("bigint")).alias(f"{k}_cells") for k in cells.KINDS],
            F.sum(wide.cast("bigint")).alias("wide_cells"),
        )

    one_row = kinds.agg(F.array(*[counters(i, name) for i, name in numbered]).alias("profile"))
    return one_row.select(F.inline("profile"))


def profile_kind(row: T.Row | dict) -> str:
    """The column kind behind one row of ``cell_profile``."""
    found = set()
    if row["boolean_cells"]:
        found.add("boolean")
    if row["whole_cells"]:
        found.add("long" if row["wide_cells"] else "int")
    if row["number_cells"]:
        found.add("double")
    if row["text_cells"]:
        found.add("string")
    return S.widen_all(found)


def infer_cells(df: DataFrame) -> T.StructType:
    """Schema of untyped text columns, from all rows.

    The driver reads one small row per column.
    """
    kinds = {r["column"]: profile_kind(r) for r in cell_profile(df).collect()}
    return S.make_schema([(name, kinds[name]) for name in df.columns])


def infer(df: DataFrame) -> T.StructType:
    """Schema of typed data: longs that all fit become int, nested becomes JSON."""
    base = S.flat(df.schema)
    longs = [f.name for f in base.fields if isinstance(f.dataType, T.LongType)]
    if not longs:
        return S.checked(base)
    fits = df.agg(
        *[
            F.coalesce(
                F.bool_and(F.col(f"`{c}`").between(_INT_MIN, _INT_MAX)), F.lit(False)
            ).alias(c)
            for c in longs
        ]
    ).first()
    return S.checked(
        T.StructType(
            [
                T.StructField(f.name, T.IntegerType(), f.nullable, f.metadata)
                if f.name in longs and fits[f.name]
                else f
                for f in base.fields
            ]
        )
    )


def json_profile(lines: DataFrame, column: str = "value") -> DataFrame:
    """For every top-level key of JSON object lines, which kinds its values have.

    Grouping by key is combined inside each task before the shuffle.
    """
    parsed = lines.select(F.try_parse_json(F.col(column)).alias("doc"))
    entries = lines.sparkSession.sql(
        "SELECT e.key AS column, schema_of_variant(e.value) AS shape, "
        "try_variant_get(e.value, '$', 'bigint') AS whole, "
        "try_variant_get(e.value, '$', 'string') AS text "
        "FROM {docs}, LATERAL variant_explode(doc) AS e",
        docs=parsed,
    )
    empty = (F.col("shape") == "VOID") | ((F.col("shape") == "STRING") & (F.col("text") == ""))
    whole = F.col("shape") == "BIGINT"
    narrow = F.col("whole").between(_INT_MIN, _INT_MAX)
    kind = (
        F.when(empty, F.lit("null"))
        .when(F.col("shape") == "BOOLEAN", F.lit("boolean"))
        .when(whole & narrow, F.lit("int"))
        .when(whole, F.lit("long"))
        .when(F.col("shape").rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.lit("double"))
        .when(F.col("shape").rlike("^(OBJECT|ARRAY)"), F.lit("json"))
        .otherwise(F.lit("string"))
    )
    # Made distinct first: every task is left with a few rows per key.
    found = entries.select("column", kind.alias("kind")).distinct()
    return found.groupBy("column").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def infer_json(lines: DataFrame, column: str = "value") -> T.StructType:
    """Schema of JSON object lines, from all of them, keys in name order.

    The driver gets one row per key, so objects that are used as maps, with more
    than ``MAX_KEYS`` different keys, are refused: they are one JSON column.
    """
    rows = json_profile(lines, column).limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise SchemaError(f"more than {MAX_KEYS} different keys; declare a schema, or keep the objects as JSON")
    found = {r["column"]: S.widen_all(k for k in r["kinds"] if k != "null") for r in rows}
    return S.make_schema(sorted(found.items()))


# ---------------------------------------------------------------- conforming


def _source(df: DataFrame, name: str) -> T.StructField | None:
    return S.find(df.schema, name)


def conform(df: DataFrame, schema: T.StructType, on_error: str = "fail") -> DataFrame:
    """Exactly the columns of ``schema``: missing ones NULL, extra ones dropped.

    ``on_error`` says what a cell that does not fit does: ``fail`` stops the
    job and names the column, ``null`` empties the cell, ``quarantine`` empties
    it and lists it in ``_bad_cells`` (see ``split_quarantine``).
    """
    if on_error not in ("fail", "null", "quarantine"):
        raise SchemaError(f"unknown on_error: {on_error}")
    # First every cell as its new type beside the old one, then the verdict on it:
    # in two steps, so that no cell is converted twice.
    read: list[Column] = []
    out: list[Column] = []
    bad: list[Column] = []
    for i, target in enumerate(schema.fields):
        source = _source(df, target.name)
        named = {"metadata": target.metadata}
        if source is None:
            out.append(F.lit(None).cast(target.dataType).alias(target.name, **named))
            continue
        raw, value = F.col(f"_raw{i}"), F.col(f"_new{i}")
        original = F.col(f"`{source.name}`")
        if source.dataType == target.dataType:
            read.append(original.alias(f"_new{i}"))
            out.append(value.alias(target.name, **named))
            continue
        read += [original.alias(f"_raw{i}"), coerce(original, source, target).alias(f"_new{i}")]
        wrong = is_bad(raw, value)
        if on_error == "fail":
            shown = F.concat(F.lit(f"column {target.name} cannot hold: "), raw.cast("string"))
            value = F.when(wrong, F.raise_error(shown).cast(target.dataType)).otherwise(value)
        elif on_error == "quarantine":
            cell = F.struct(F.lit(target.name).alias("column"), raw.cast("string").alias("value"))
            bad.append(F.when(wrong, cell))
        out.append(value.alias(target.name, **named))
    if on_error == "quarantine":
        listed = F.filter(F.array(*bad), lambda c: c.isNotNull()) if bad else F.array()
        out.append(listed.cast(_BAD_TYPE).alias(BAD_CELLS))
    return df.select(*read).select(*out) if read else df.select(*out)


def split_quarantine(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good rows, set-aside rows)`` of a quarantining ``conform``."""
    clean = F.size(BAD_CELLS) == 0
    return conformed.filter(clean).drop(BAD_CELLS), conformed.filter(~clean)


def read_cells(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Text cells as typed columns, with the null words empty.

    Without a schema the types come from all the cells of each column.
    """
    wanted = schema or infer_cells(df)
    columns = []
    for target in wanted.fields:
        raw = F.col(f"`{target.name}`")
        kind = S.kind_of(target)
        if kind == "boolean":
            value = cells.cell_boolean(raw)
        elif kind in ("int", "long"):
            value = cells.cell_whole(raw).cast(target.dataType)
        elif kind == "double":
            value = cells.cell_number(raw)
        elif kind == "string":
            value = cells.cell_text(raw)
        else:
            value = coerce(cells.cell_text(raw), T.StringType(), target)
        columns.append(value.alias(target.name))
    return df.select(*columns)


def union_evolved(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose schemas grew over time; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
