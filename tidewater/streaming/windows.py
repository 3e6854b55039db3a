"""Windowed observations over a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_observations(events: DataFrame, time_col: str, strategy: str, sentiment: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, meta_strategy, n, sentiment of tumbling windows; rows later than ``late`` are left out of windows that have closed."""
    w = F.window(time_col, width)
    got = events.withWatermark(time_col, late).groupBy(w.alias("w"), F.col(strategy).alias("meta_strategy")).agg(F.count("*").alias("n"), F.avg(sentiment).alias("sentiment"))
    return got.select(F.col("w.start").alias("window_start"), "meta_strategy", "n", "sentiment")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends closed windows to Parquet; each is written once, also over restarts."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
