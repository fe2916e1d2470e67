"""A stream run to the end of what there is, its rows read back from files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foretide.sources.shared import new_path


def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the tables as a stream of its file."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What the stream's query appends until all input is read; state and progress are in the shared folder, so a
    restart goes on where it stopped."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    # Large state belongs on disk, and states of several parts need this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
