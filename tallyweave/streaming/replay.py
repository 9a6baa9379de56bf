"""Tables read as streams, and what a stream yields until it has read all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.shared import folder
from tallyweave.streaming.stateful import PROVIDER


def as_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The Parquet files of a path, a folder or one file, so many a micro-batch."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    parent, _, name = path.rstrip("/").rpartition("/")
    single = all(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    return reader.option("pathGlobFilter", name).parquet(parent) if single and table.inputFiles() else reader.parquet(path)


def drained(stream: DataFrame, at: str | None = None, timeout: int = 3600) -> DataFrame:
    """Runs a stream over all that is there and returns what it has written; run again at the same place, it goes on from its checkpoint."""
    spark = stream.sparkSession
    at, before = at or folder(spark, "stream"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream at {at} took more than {timeout} s")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
