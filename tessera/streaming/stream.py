"""Structured Streaming forms: resume by state, event-time windows, runs. Resume by a ledger and early stopping are beside this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resumed(stream: DataFrame, id_col: str = "id", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each id once; with an event time, ids are forgotten after the delay, so state stays bounded."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_col])
    return stream.dropDuplicates([id_col])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; rows later than the delay are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into the table at ``path`` and reads it; in update mode it holds every update."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("parquet").start(path) if mode == "append" else w.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_each(df: DataFrame, checkpoint: str, each) -> None:
    """Runs a stream over what is available, each batch with its number through ``each``, which must bear a replay."""
    df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: each(batch, n) and None).start().awaitTermination()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
