"""Streams: popularity counts of events in tumbling windows, with late data bounded by a watermark.

An extension for timestamped ratings and events; the batch engine does not need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.runtime import scratch


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files at `path`, a folder or one file, as a stream, with the schema of what lies there."""
    schema = spark.read.parquet(path).schema
    # as a pattern that only the path itself matches: plain paths of a stream must be folders
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def popularity(events: DataFrame, time: str, kind: str, value: str, window: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """(window_start, kind, n, total): events per window and kind; rows later than `late` are dropped once it has passed."""
    rows = events.select(F.col(time).cast("timestamp").alias("at"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value")).where("at IS NOT NULL")
    if late:
        rows = rows.withWatermark("at", late)
    counted = rows.groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "n", "total")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived and give what it wrote. Append mode: windows that the watermark closed."""
    base = scratch(stream.sparkSession, f"stream-{name}")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")
