"""File sources and starts that every stream here uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(
    spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, then stops. ``checkpoint`` must be on the shared folder."""
    started = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def run_keyed(writer, checkpoint: str, spark: SparkSession) -> StreamingQuery:
    """``run_available`` for streams with state by key, which need the RocksDB state store. A query keeps the
    store it was started with, so the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_available(writer, checkpoint)
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)
