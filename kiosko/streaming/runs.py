"""The run log as a stream: the state of each source, and failures by window with late rows held to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failures_by_window(runs: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, source_id, runs, failures`` of a stream of runs ``source_id, ran_at, ok``; rows later than ``late`` are dropped."""
    rows = runs.withWatermark("ran_at", late).groupBy(F.window("ran_at", window), "source_id")
    got = rows.agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failures"))
    return got.select(F.col("window.start").alias("start"), "source_id", "runs", "failures")


def to_parquet(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """The closed windows of a stream appended to a folder, as far as there are rows now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
