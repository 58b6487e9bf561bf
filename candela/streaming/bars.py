"""Bar building over a tick stream (the bar source of ``sources.bars`` for
data that keeps arriving).

Ticks are aggregated per (ticker, event-time bucket) with a watermark, so
state is bounded: a bucket is emitted once (append mode) when the watermark
passes its end, and its state is dropped. Open/Close are the first/last
prices by the given order key, as in the batch adapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ticks(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_bars(ticks: DataFrame, ticker: Column, ts: str, price: Column, volume: Column,
                order: list[Column], bucket: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """OHLCV per (ticker, ``bucket`` window of ``ts``); late ticks within ``watermark`` are merged."""
    key = F.struct(*order)
    win = F.window(F.col(ts), bucket)
    # watermarks need an instant type; local timestamps are read in the session time zone
    ticks = ticks.withColumn(ts, F.col(ts).cast("timestamp"))
    return (ticks.withWatermark(ts, watermark)
            .groupBy(ticker.alias("Ticker"), win.alias("_w"))
            .agg(F.min_by(price, key).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"),
                 F.max_by(price, key).alias("Close"), F.sum(volume).cast("bigint").alias("Volume"))
            .select("Ticker", F.col("_w.start").alias("Date"), "Open", "High", "Low", "Close", "Volume"))


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append finished bars to a Parquet folder; the checkpoint makes restarts exactly-once."""
    w = (bars.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
