"""Event counts of a stream.

Every sink writes a micro-batch under its batch id in overwrite mode, so a
batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.operators.events import window_counts
from rxweave.session import shared_folder
from rxweave.streaming.files import put as _put
from rxweave.streaming.files import run_available


def stream_event_log(log: DataFrame, width: str, delay: str, folder: str | None = None) -> str:
    """Events per type and window, kept up to date as they arrive."""
    out = folder or shared_folder(log.sparkSession, "events")
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    counts = window_counts(timed, width)
    run_available(counts, lambda df, batch: _put(df, f"{out}/counts", batch), f"{out}/_checkpoint", "update")
    return out


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Newest count of each window and type over all batches."""
    rows = spark.read.parquet(f"{folder}/counts")
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
