"""Candle tables: (symbol, ts, open, high, low, close, volume), ts in epoch microseconds, one row for each symbol and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of exchange candle files, fixed values.
KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"]
PRICES = ["open", "high", "low", "close", "volume"]


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp without zone, whatever the session's zone."""
    gap = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (gap.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")


def from_events(spark: SparkSession, sf_dir: str, step: str = "hour") -> DataFrame:
    """Candles of the events table: one symbol for each event type, opens and closes by (ts, event_id)."""
    size = {"minute": 60_000_000, "hour": 3_600_000_000}[step]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), micros(F.col("ts")).alias("us"), "event_id", "value")
    at = F.struct("us", "event_id")
    out = e.groupBy("symbol", (F.floor(F.col("us") / size) * size).cast("long").alias("ts")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out


def read_klines(spark: SparkSession, paths: list[str] | str, symbol: str | None = None) -> DataFrame:
    """Exchange candle files (CSV, with or without a header row). Rows that do not parse are dropped, repeated times kept once.

    Without a symbol it is the first part of the file's name, up to '-' or '_'.
    """
    raw = spark.read.csv(paths, schema=", ".join(f"{c} string" for c in KLINE_COLUMNS), header=False, mode="PERMISSIVE")
    name = F.lit(symbol) if symbol else F.regexp_extract(F.col("_metadata.file_name"), r"^([^-_.]+)", 1)
    ts = (F.col("open_time").try_cast("long") * 1000).alias("ts")
    out = raw.select(name.alias("symbol"), ts, *[F.col(c).try_cast("double").alias(c) for c in PRICES]).dropna()
    return out.dropDuplicates(["symbol", "ts"])


def between(candles: DataFrame, start: int | None = None, end: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Rows from start to end, both included, in epoch microseconds; the filters reach the files."""
    for condition in (start is not None and F.col("ts") >= start, end is not None and F.col("ts") <= end, symbols is not None and F.col("symbol").isin(symbols or [])):
        if condition is not False:
            candles = candles.where(condition)
    return candles


def random_walk(spark: SparkSession, symbols: int, length: int, start: float = 100.0, seed: int = 0) -> DataFrame:
    """Minute candles of geometric random walks from 2000-01-01: returns N(0, 0.01), highs and lows within half a percent, lognormal volumes."""
    r = spark.range(symbols * length).withColumn("n", F.col("id") % length).withColumn("symbol", F.concat(F.lit("S"), F.floor(F.col("id") / length)))
    w = Window.partitionBy("symbol").orderBy("n")
    r = r.withColumn("r", F.randn(seed) * 0.01).withColumn("u", F.rand(seed + 1)).withColumn("v", F.rand(seed + 2)).withColumn("volume", F.exp(F.randn(seed + 3)))
    r = r.withColumn("close", start * F.exp(F.sum("r").over(w))).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(start)))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    ts = F.lit(946_684_800_000_000) + F.col("n") * 60_000_000
    return r.select("symbol", ts.alias("ts"), "open", (top * (1 + 0.005 * F.col("u"))).alias("high"), (bottom * (1 - 0.005 * F.col("v"))).alias("low"), "close", "volume")


def write_candles(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol and month, so that both prune files."""
    month = F.date_format(F.timestamp_micros("ts"), "yyyy-MM")
    df.withColumn("month", month).repartition("symbol", "month").write.mode(mode).partitionBy("symbol", "month").parquet(path)
