"""CSV, TSV, JSON lines and JSON documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.conform import conform, infer_json, read_cells
from millrace.operators.once import computed_once

# File endings and the format they mean; anything else is CSV.
ENDINGS = {".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}


def file_format(path: str, declared: str = "auto") -> str:
    if declared.lower() != "auto":
        return declared.lower()
    name = path.split("?", 1)[0].lower()
    return next((kind for ending, kind in ENDINGS.items() if name.endswith(ending)), "csv")


def read_delimited_text(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
    multi_line: bool = False,
) -> DataFrame:
    """A file with a header row, every cell as text; surplus cells are dropped.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per
    file; without it large files are read by many tasks.
    """
    reader = spark.read.option("header", True).option("sep", delimiter)
    reader = reader.option("multiLine", multi_line)
    return reader.option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Typed columns: given, or found by looking at every cell once."""
    return read_cells(read_delimited_text(spark, path, delimiter, encoding, multi_line), schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line; blank lines do not count."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wanted = schema or infer_json(lines)
    return json_columns(lines.select(F.parse_json("value").alias("doc")), wanted)


def json_columns(docs: DataFrame, schema: T.StructType) -> DataFrame:
    """A variant column ``doc`` as the columns of ``schema``.

    Each key is read as text (nested values as JSON) and then conformed, so a
    value of another type follows the same rules as everywhere else.
    """
    cells = docs.select(
        *[
            F.try_variant_get("doc", _path(f.name), "string").alias(f.name) for f in schema.fields
        ]
    )
    return conform(cells, schema, on_error="fail")


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def read_json_documents(
    spark: SparkSession, path: str, record_path: str | None = None
) -> DataFrame:
    """Records of JSON documents, one file one document, as a variant column ``doc``.

    ``record_path`` (``data.items``) leads to the records.  A missing key gives
    no rows, one object is one record, and a path through anything but objects,
    or to anything but an object or a list, stops the job.
    """
    text = spark.read.text(path, wholetext=True)
    docs = computed_once(text, doc=F.parse_json("value")).select("doc")
    return explode_records(docs, record_path)


def explode_records(docs: DataFrame, record_path: str | None = None) -> DataFrame:
    """The records inside a variant column ``doc`` (see ``read_json_documents``)."""
    place = docs.select(F.col("doc").alias("place"))
    for part in record_path.split(".") if record_path else []:
        wrong = F.raise_error(F.lit(f"record path {record_path} does not match the document"))
        inside = computed_once(
            place, inside=F.try_variant_get("place", _path(part), "variant")
        )
        # What is missing here may be missing in an object, but in nothing else.
        place = inside.select(
            F.when(F.col("inside").isNotNull(), F.col("inside"))
            .when(F.col("place").isNull() | _is_object("place"), F.lit(None).cast("variant"))
            .otherwise(wrong.cast("variant"))
            .alias("place")
        )
    found = computed_once(
        place.filter(F.col("place").isNotNull()) if record_path else place,
        listed=F.try_variant_get("place", "$", "array<variant>"),
    )
    records = (
        F.when(F.col("listed").isNotNull(), F.col("listed"))
        .when(_is_object("place"), F.array("place"))
        .otherwise(F.raise_error(F.lit("no record list in the document")).cast("array<variant>"))
    )
    return found.select(F.explode(records).alias("doc"))


def _is_object(column: str) -> Column:
    return F.schema_of_variant(column).startswith("OBJECT")


def read_file(spark: SparkSession, path: str, declared: str = "auto", **options: object) -> DataFrame:
    """Any of the formats, chosen by the file ending unless declared."""
    kind = file_format(path, declared)
    if kind in ("csv", "tsv"):
        delimiter = "\t" if kind == "tsv" else str(options.get("delimiter", ","))
        return read_csv(spark, path, delimiter, str(options.get("encoding", "utf-8")))
    if kind == "jsonl":
        return read_json_lines(spark, path)
    docs = read_json_documents(spark, path, options.get("record_path"))
    text = docs.select(F.to_json("doc").alias("value"))
    return json_columns(docs, infer_json(text))


def empty_relation(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, but the right columns and types."""
    return spark.createDataFrame([], schema)
