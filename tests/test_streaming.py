"""Streams of files in pieces, with late rows, against the batch bars."""

import pytest
from pyspark.sql import functions as F

from tallow.operators import bars
from tallow.sources.candles import random_walk
from tallow.streaming import bars as streamed

MINUTE = 60_000_000


@pytest.fixture
def pieces(spark, tmp_path):
    """Two symbols' candles in three files; some rows come a file late, and a last candle far off moves the watermark over all."""
    walk = random_walk(spark, 2, 240, seed=3).where("ts % 420000000 > 60000000")
    walk.write.parquet(f"{tmp_path}/walk")
    walk = spark.read.parquet(f"{tmp_path}/walk")
    start = walk.agg(F.min("ts")).first()[0]
    far = walk.groupBy("symbol").agg(*[F.first(c).alias(c) for c in ("open", "high", "low", "close", "volume")]).withColumn("ts", F.lit(start + MINUTE * 100_000)).select(walk.columns)
    minute = F.floor((F.col("ts") - start) / MINUTE)
    part = F.floor(minute / 80) + F.when(minute.isin(70, 75, 150), 1).otherwise(0)
    schema = walk.schema
    for k in range(3):
        walk.where(part == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    far.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    far.withColumn("ts", F.col("ts") + MINUTE * 100_000).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return walk, far, stream, str(tmp_path)


def run(df, path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.table(name)


def test_streamed_time_bars(pieces):
    walk, far, stream, path = pieces
    got = run(streamed.time_bars(streamed.timed(stream, "30 minutes"), 600), path, "time_bars")
    want = bars.time_bars(walk, 600).drop("bar_id")
    far_edge = far.agg(F.min("ts")).first()[0]
    got = got.where(F.col("ts") < far_edge)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 40


@pytest.mark.parametrize("method", ["dollar", "imbalance"])
def test_streamed_event_bars(pieces, method):
    walk, far, stream, path = pieces
    got = run(streamed.event_mapping(streamed.timed(stream, "30 minutes"), method, 300), path, f"{method}_bars")
    want = bars.event_mapping(walk, method, 300, keep_partial=True)
    far_edge = far.agg(F.min("ts")).first()[0]
    assert sorted(map(tuple, got.where(F.col("timestamp") < far_edge).collect())) == sorted(map(tuple, want.collect())) and want.agg(F.max("bar_id")).first()[0] > 5
