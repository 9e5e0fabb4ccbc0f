"""Tables as files of CSV, JSON lines, ORC or Parquet, in folders by partition, and back without loss.

A record of CSV or JSON is one line, so that a file is split between tasks however long it is: in CSV a line break within a field is written
as an escape (backslash and n or r; a backslash is doubled, null is backslash and N). Lines are parsed whole, whatever columns are asked for, so which are
malformed doesn't depend on the query; a filter on a column of folders reads these folders only. On writing, rows are dealt by folder
and by size (Spark's rebalance): a folder with a third of all rows is written by many tasks, most small ones by one.

Cases: lines with too few or too many fields, or with a field that isn't of its type, are kept apart as they stand, with their file; blank
lines are no records; null and empty texts stay what they are, but for a column of folders, where an empty text is read as null (Spark
names both folders alike); rows that repeat stay; of an empty table nothing is read; CSV holds no nested types, which are refused;
times with a zone are written with their offset from UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("csv", "json", "orc", "parquet")
_BAD = "_malformed"
_INSTANT, _LOCAL = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}
_JSON = {"timestampFormat": _INSTANT, "timestampNTZFormat": _LOCAL}


def _known(kind: str, names: list[str], by: list[str]) -> None:
    if kind not in KINDS:
        raise ValueError(f"a kind of {KINDS} is needed, not {kind}")
    if missing := set(by) - set(names):
        raise ValueError(f"no columns: {sorted(missing)}")
    if len(by) == len(names):
        raise ValueError("a column besides those of folders is needed")
    if taken := {_BAD, "_file"} & set(names) | {"value"} & set(by):
        raise ValueError(f"names that readers of lines use: {sorted(taken)}")


def _text(column: Column, kind: T.DataType) -> Column:
    """A CSV field that `_typed` reads back."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"CSV holds no {kind.simpleString()}")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, T.TimestampType):
        return F.date_format(column, _INSTANT)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        for plain, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            column = F.replace(column, F.lit(plain), F.lit(escape))
        return column
    return column.cast("string")


def _typed(column: Column, kind: T.DataType) -> Column:
    """The value of a CSV field, null if it isn't of its type."""
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(column, F.lit("base64"))
    if isinstance(kind, T.StringType):  # a doubled backslash is set aside first, as what follows it is no escape
        parts = F.transform(F.split(column, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
        return F.array_join(parts, "\\")
    return column.try_cast(kind)


def write_files(df: DataFrame, path: str, kind: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Write `df` to the folder `path`, in folders by the columns `by`."""
    by = list(by or [])
    _known(kind, df.columns, by)
    if kind == "csv":
        df = df.select(*[F.col(f.name) if f.name in by else _text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
    writer = df.hint("rebalance", *[F.col(b) for b in by]).write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    options = {"csv": _CSV | {"quoteAll": "true"}, "json": _JSON | {"ignoreNullFields": "false"}}.get(kind, {})
    writer.format(kind).options(**options).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: T.StructType, by: list[str] | None = None, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows at `path`, in the columns of `schema`; and _file and _malformed (the line) of lines that aren't such rows.

    by: the columns of folders. header: the first line of each CSV file names the columns, and lines equal to it are no records.
    """
    by, names = list(by or []), schema.names
    _known(kind, names, by)
    if kind in ("orc", "parquet"):
        rows = spark.read.schema(schema).format(kind).load(path).select(*names)
        return rows, rows.where("false").select(F.lit("").alias("_file"), F.lit("").alias(_BAD))
    folders = T.StructType([T.StructField("value", T.StringType()), *[schema[b] for b in by]])
    lines = spark.read.schema(folders).text(path).where("trim(value) <> ''")
    if header:
        lines = lines.where(~F.regexp_replace("value", '"', "").eqNullSafe(",".join(n for n in names if n not in by)))
    inner = [f for f in schema if f.name not in by]
    bad = T.StructField(_BAD, T.StringType())
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    ddl = lambda fields: ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    own = lambda n: F.col("_row").getField(n)
    files = F.col("_metadata.file_path").alias("_file")
    if kind == "csv":
        texts = [T.StructField(f.name, T.StringType()) for f in inner]
        parsed = lines.select(files, "value", *by, F.from_csv("value", ddl([*texts, bad]), _CSV | mode).alias("_row"))
        values = parsed.select("_file", "value", *by, own(_BAD).isNotNull().alias("_bad"), F.struct(*[own(f.name).alias(f.name) for f in inner]).alias("_text"), F.struct(*[_typed(own(f.name), f.dataType).alias(f.name) for f in inner]).alias("_row"))
        fails = F.col("_bad")
        for f in inner:
            fails = fails | (F.col("_text").getField(f.name).isNotNull() & own(f.name).isNull())
    else:
        values = lines.select(files, "value", *by, F.from_json("value", ddl([*inner, bad]), _JSON | mode).alias("_row"))
        fails = F.col("_row").isNull() | own(_BAD).isNotNull()
    rows = values.where(~fails).select(*[F.col(n) if n in by else own(n).alias(n) for n in names])
    return rows, values.where(fails).select("_file", F.col("value").alias(_BAD))
