"""JSON texts as columns, of a schema that all rows together have.

The schema comes from one aggregation over the parsed texts (merged in every task, so one schema a task is sent); then each text
is parsed to a variant and its fields are taken as typed columns. A field whose types differ between rows becomes text.

Cases: texts that aren't JSON, or are no objects, are kept apart with their rows; so are nulls; a field that a row doesn't have is null; a field
that is null in every row is text; what follows an object in its text isn't looked at, as Spark's parser doesn't; a table without objects gives no further column; names of fields that clash with columns are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_types(df: DataFrame, column: str) -> str | None:
    """The merged type of the objects of a JSON column, as a struct, or None without any."""
    found = _objects(df, column).agg(F.schema_of_variant_agg("_value")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return None
    plain = re.sub(r"\bOBJECT<", "STRUCT<", found)
    return re.sub(r"\b(VARIANT|VOID)\b", "STRING", plain)


def _parsed(df: DataFrame, column: str) -> DataFrame:
    value = F.try_parse_json(F.col(column))
    return df.withColumn("_value", value).withColumn("_is_object", F.coalesce(F.schema_of_variant("_value").startswith("OBJECT<"), F.lit(False)))


def _objects(df: DataFrame, column: str) -> DataFrame:
    return _parsed(df, column).where("_is_object")


def to_columns(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose text is an object, with a column a field; and the other rows as they are."""
    apart = _parsed(df, column).where("not _is_object").drop("_value", "_is_object")
    kind = field_types(df, column)
    rows = _objects(df, column)
    if kind is None:
        return rows.drop("_value", "_is_object"), apart
    fields = rows.withColumn("_fields", F.try_variant_get("_value", "$", kind))
    names = fields.schema["_fields"].dataType.names
    if clash := set(names) & set(df.columns):
        raise ValueError(f"fields with names of columns: {sorted(clash)}")
    return fields.select(*df.columns, *[F.col("_fields").getField(n).alias(n) for n in names]), apart
