"""Constant scan: one row, one literal, no table read and no shuffle."""

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the surveyed behaviour returns exactly this text.
GREETING = "Hello World!"


def constant_greeting(spark: SparkSession) -> DataFrame:
    """One row, `greeting` string. Plans to a projection over OneRowRelation."""
    return spark.sql(f"SELECT '{GREETING}' AS greeting")
