"""Parquet tables of one input folder, read with Spark only, so any store that Spark reads works."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`: a Parquet file, or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
