"""Intermediate tables in the folder that the cluster shares, and a check of what operators are given."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a session on one machine gets a temporary one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, *by: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, in folders by the columns `by`.

    It cuts the lineage, and the files outlive executors; they go when the driver ends, or with `forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for table in tables:
        files, at = _file_system(table.sparkSession, table._written_to)
        files.delete(at, True)


def whole_numbers(*tables: DataFrame, column: str = "doc_id") -> None:
    """Refuse ids of another kind in words, before a task fails on one of them."""
    for table in tables:
        kind = table.schema[column].dataType
        if not isinstance(kind, IntegralType | NullType):
            raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}; number the rows first")
