"""Following records as they arrive: file streams, running summaries, windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.warehouse import METRICS, metrics_summary, valid_metrics


def tail_metrics(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Training records of the JSON-lines files that appear in a folder, each whole line once."""
    stream = spark.readStream.schema(METRICS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch)
    return valid_metrics(stream.json(folder))


def running_summary(metrics: DataFrame) -> DataFrame:
    """The summary by algorithm so far (complete output mode)."""
    return metrics_summary(metrics, ["algorithm_key"]) if "algorithm_key" in metrics.columns else metrics_summary(metrics)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value); works on streams and tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    got = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def follow(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Hand each micro-batch to `put`; every: a pause such as "2 seconds", or None to stop once all that is there is done."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
