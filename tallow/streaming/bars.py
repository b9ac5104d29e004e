"""Decision bars of candle streams, equal to those of operators.bars over the same rows.

Rows that come late, but within the watermark, are
put in their place; those behind it are dropped, as Spark's windows drop them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rolling import Window

PRICES = ["open", "high", "low", "close", "volume"]


def timed(candles: DataFrame, delay: str) -> DataFrame:
    """candles (symbol, ts, open .. volume) with event_time and a watermark so far behind the latest.

    event_time is a microsecond before ts: Spark's windows are open at their right
    edge, bars closed there.
    """
    return candles.withColumn("event_time", F.timestamp_micros(F.col("ts") - 1)).withWatermark("event_time", delay)


def time_bars(candles: DataFrame, target_seconds: int = 14_400) -> DataFrame:
    """(symbol, ts, open .. volume) of timed candles: bins closed and named at their right edge, each once the watermark has passed it.

    Bars come without numbers: a bar's number is that of the symbol's bars before it.
    """
    step = max(target_seconds // 60, 1) * 60
    out = candles.groupBy("symbol", F.window("event_time", f"{step} seconds").alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.unix_micros("w.end").alias("ts"), *PRICES)


_STATE = "last double, tick double, bar long, total double, sizes array<double>, waiting array<struct<ts: long, close: double, volume: double>>"


def _events(method: str, minutes: int, window: int):
    """A symbol's rows up to the watermark, in order: each row's bar. Later rows wait in the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tick, bar, total, sizes, waiting = state.get if state.exists else (None, 1.0, 0, 0.0, [], [])
        rows = [tuple(r) for r in waiting]
        for b in batches:
            rows += list(b[["ts", "close", "volume"]].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(r for r in rows if r[0] <= mark)
        waiting = sorted(r for r in rows if r[0] > mark)
        held, out = Window(window, 0.5), []
        for x in sizes:
            held.push(x)
        for ts, close, volume in ready:
            if last is not None and close != last:
                tick = 1.0 if close > last else -1.0
            x = abs(close * volume) if method == "dollar" else tick * volume
            limit = max(held.push(abs(x)) * minutes, 1e-6)
            out.append((key[0], ts, bar))
            last, total = close, total + x
            if (abs(total) if method == "imbalance" else total) >= limit > 0:
                bar, total = bar + 1, 0.0
        state.update((last, tick, bar, total, list(held.rows), waiting))
        if waiting:
            state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1)
        yield pd.DataFrame(out, columns=["symbol", "timestamp", "bar_id"])

    return run


def event_mapping(candles: DataFrame, method: str = "dollar", target_seconds: int = 14_400, window: int = 60) -> DataFrame:
    """(symbol, timestamp, bar_id) of timed candles, as batch event_mapping with keep_partial gives it, each row once the watermark has passed it.

    A symbol's state is its last sizes, the running sum, and the rows that the watermark has not reached.
    """
    if method not in ("dollar", "imbalance"):
        raise ValueError(f"unsupported method {method}")
    kind = candles.schema["symbol"].dataType.simpleString()
    rows = candles.select("symbol", "ts", "close", "volume", "event_time").groupBy("symbol")
    return rows.applyInPandasWithState(_events(method, max(target_seconds // 60, 1), max(window, 1)), f"symbol {kind}, timestamp long, bar_id long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
