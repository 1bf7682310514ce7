"""Pages as they arrive: ingestion that goes on where it stopped, and counts that follow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16, only: str = "*") -> DataFrame:
    """Pages of parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", only).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str] = ("book", "page")) -> None:
    """Append what is new to the table at target, and stop. Of rows with equal keys in a batch one is kept; batches written before a
    failure are overwritten, not doubled: each has its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live(stream: DataFrame, checkpoint: str, recompute: Callable[[DataFrame, int], None], every: str = "10 seconds"):
    """Recompute an estimate on each batch, at most every so often; gives the running query, which stop() ends."""
    return stream.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def arrivals(stream: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """(library, day, pages) by time of arrival, with a watermark for late rows; also on a batch table."""
    return stream.withWatermark("arrived_at", late).groupBy("library", F.window("arrived_at", window)["start"].alias("day")).agg(F.count("*").alias("pages"))
