"""A stream of a table's files, run until all files are read, and what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources.shared import shared_folder

#: State in RocksDB, which keyed state with timers needs.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def streamed(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """The Parquet file, or the folder of files, at `path` as a stream of the columns of `like`, `files` of them a batch (all if None)."""
    reader = spark.readStream.schema(like.schema)
    either = f"{path[:-1]}[{path[-1]}]"  # a stream reads a single file by a pattern only
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(either)


def run_to_end(stream: DataFrame, checkpoint: str | None = None, into: str | None = None) -> DataFrame:
    """Append what `stream` gives until its input is read, and return what stands in `into` (new folders if none are given).

    With the folders of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    into, checkpoint = into or shared_folder(spark, "stream"), checkpoint or shared_folder(spark, "stream-state")
    before = spark.conf.get(STATE[0], None)
    spark.conf.set(*STATE)
    try:  # a query keeps the settings that it was started with
        query = stream.writeStream.outputMode("append").format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE[0])
        else:
            spark.conf.set(STATE[0], before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(into)
