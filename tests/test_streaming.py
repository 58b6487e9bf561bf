"""Streaming bars equal the batch bars for every bucket the watermark has closed."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from candela.sources import bars as src
from candela.streaming.bars import read_ticks, stream_bars, write_bars


def test_stream_bars_match_batch(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = tempfile.mkdtemp(prefix="candela-stream-", dir="/tmp")
    ticks = read_ticks(spark, f"{SF_SMALL}/events*.parquet", events.schema)
    bars = stream_bars(ticks, F.col("event_type"), "ts", F.col("value"), F.lit(1),
                       [F.col("ts"), F.col("event_id")], "1 hour", "1 hour")
    q = write_bars(bars, f"{out}/bars", f"{out}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/bars")
    batch = src.bars_hourly(spark, SF_SMALL).withColumn("Date", F.col("Date").cast(got.schema["Date"].dataType))
    emitted = got.count()
    assert emitted > 0
    # every emitted bucket equals the batch bar; unemitted ones are only the last, still-open buckets
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
    max_ts = events.agg(F.max("ts")).first()[0]
    missing = batch.select(*got.columns).exceptAll(got)
    assert missing.where(F.col("Date") < F.lit(max_ts) - F.expr("INTERVAL 2 HOURS")).count() == 0
