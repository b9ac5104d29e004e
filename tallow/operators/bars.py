"""Decision bars: by time, by traded value, by volume imbalance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, require_columns, schema_of
from ..functions.rolling import with_quantiles
from ..sources.tables import settled

MINUTE_US = 60_000_000


def time_bars(candles: DataFrame, target_seconds: int = 14_400) -> DataFrame:
    """(symbol, bar_id, ts, open .. volume): bins closed and named at their right edge, empty ones left out, numbered from 0."""
    require_columns(candles, "symbol", "ts", "open", "high", "low", "close", "volume")
    step = max(target_seconds // 60, 1) * MINUTE_US
    edge = (F.ceil(F.col("ts") / F.lit(step).cast("decimal(20,0)")) * step).cast("long")
    bars = candles.groupBy("symbol", edge.alias("edge")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    number = (F.row_number().over(Window.partitionBy("symbol").orderBy("edge")) - 1).cast("long")
    return bars.select("symbol", number.alias("bar_id"), F.col("edge").alias("ts"), "open", "high", "low", "close", "volume")


def time_mapping(candles: DataFrame, bars: DataFrame, target_seconds: int = 14_400) -> DataFrame:
    """(symbol, timestamp, bar_id): the first bar at or after each candle, found by its computed edge, not by a range join."""
    step = max(target_seconds // 60, 1) * MINUTE_US
    edge = (F.ceil(F.col("ts") / F.lit(step).cast("decimal(20,0)")) * step).cast("long")
    rows = candles.select("symbol", F.col("ts").alias("timestamp"), edge.alias("edge"))
    return rows.join(bars.select("symbol", F.col("ts").alias("edge"), "bar_id"), ["symbol", "edge"]).select("symbol", "timestamp", "bar_id")


def _measured(candles: DataFrame, method: str, target_seconds: int, window: int) -> DataFrame:
    """candles with x, what a candle adds to the running sum, and threshold, the rolling median of its size times the target's minutes."""
    tick = F.last(F.nullif(F.signum(F.col("close") - F.lag("close").over(by_time())), F.lit(0.0)), ignorenulls=True).over(by_time())
    df = candles.withColumn("tick", F.coalesce(tick, F.lit(1.0)))
    size = F.abs(F.col("close") * F.col("volume")) if method == "dollar" else F.abs(F.col("tick") * F.col("volume"))
    df = df.withColumn("size", size).withColumn("x", F.col("size") if method == "dollar" else F.col("tick") * F.col("volume"))
    df = with_quantiles(df, {"median": ("size", max(window, 1), 0.5)})
    return df.withColumn("threshold", F.greatest(F.col("median") * max(target_seconds // 60, 1), F.lit(1e-6))).drop("size", "tick", "median")


def _folded(absolute: bool):
    """For mapInArrow over rows sorted by symbol and time: the running sum and bar of each row. Only the last row's state is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar, total = 0, 0.0
        for rows in batches:
            ids, sums = [], []
            for x, limit, first in zip(*[rows.column(c).to_pylist() for c in ("x", "threshold", "first")], strict=True):
                if first:
                    bar, total = 0, 0.0
                ids.append(bar)
                total += x
                size = abs(total) if absolute else total
                sums.append(size)
                if size >= limit > 0:
                    bar, total = bar + 1, 0.0
            yield pa.record_batch([rows.column("symbol"), rows.column("ts"), pa.array(ids, pa.int64()), pa.array(sums, pa.float64()), rows.column("threshold")], names=["symbol", "timestamp", "bar_id", "total", "threshold"])

    return run


def _carried(absolute: bool, last: bool):
    """For a chunk of a symbol's rows: its fold from the total that the chunk begins with; with last, only the bars closed and the total it ends with."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ts")
        total, bar = rows["entry"][0].as_py(), 0
        ids, sums = [], []
        for x, limit in zip(rows["x"].to_pylist(), rows["threshold"].to_pylist(), strict=True):
            ids.append(bar)
            total += x
            size = abs(total) if absolute else total
            sums.append(size)
            if size >= limit > 0:
                bar, total = bar + 1, 0.0
        if last:
            return rows.slice(0, 1).select(["symbol", "chunk", "entry"]).append_column("closed", pa.array([bar], pa.int64())).append_column("left", pa.array([total]))
        return rows.append_column("own", pa.array(ids, pa.int64())).append_column("total", pa.array(sums, pa.float64()))

    return run


def _chunked(rows: DataFrame, absolute: bool, chunk: int) -> DataFrame:
    """The fold of rows (symbol, ts, x, threshold) in chunks of so many rows, all at once.

    Every chunk is folded from no total; then each that began with another total
    than the one before it ended with is folded anew, until none is left. Bars
    start anew at each threshold, so a chunk's end seldom depends on its begin,
    and few chunks are folded more than twice. A symbol's chunks, not its rows,
    come together.
    """
    rows = settled(rows.withColumn("chunk", F.floor((F.row_number().over(by_time()) - 1) / chunk)))
    fold = lambda df: df.groupBy("symbol", "chunk").applyInArrow(_carried(absolute, True), schema_of(df, "symbol", "chunk", "entry", closed="long", left="double"))
    by_chunk = Window.partitionBy("symbol").orderBy("chunk")  # a row for each chunk
    states, wrong = None, rows.select("symbol", "chunk").distinct().withColumn("entry", F.lit(0.0))
    while not wrong.isEmpty():
        new = fold(rows.join(wrong, ["symbol", "chunk"]))
        states = settled(new if states is None else states.join(wrong, ["symbol", "chunk"], "left_anti").unionByName(new))
        begin = F.coalesce(F.lag("left").over(by_chunk), F.lit(0.0))
        wrong = states.withColumn("begin", begin).where("begin <> entry").select("symbol", "chunk", F.col("begin").alias("entry"))
    if states is None:
        states = fold(rows.withColumn("entry", F.lit(0.0)))
    first = F.sum("closed").over(by_chunk) - F.col("closed")
    parts = rows.join(states.select("symbol", "chunk", "entry", first.alias("first")), ["symbol", "chunk"])
    parts = parts.groupBy("symbol", "chunk").applyInArrow(_carried(absolute, False), schema_of(parts, own="long", total="double"))
    return parts.select("symbol", F.col("ts").alias("timestamp"), (F.col("first") + F.col("own")).alias("bar_id"), "total", "threshold")


def event_mapping(candles: DataFrame, method: str = "dollar", target_seconds: int = 14_400, window: int = 60, keep_partial: bool = False, least: float = 0.5, chunk: int | None = None) -> DataFrame:
    """(symbol, timestamp, bar_id) of dollar or imbalance bars: a running sum that starts anew when it reaches the threshold.

    The fold is sequential in time: a symbol's rows are sorted in one task and
    stream through it in batches. With chunk a symbol's rows are folded in chunks
    of so many, each a task's work, with the same result. Sums, medians and the
    bars stay native.
    """
    if method not in ("dollar", "imbalance"):
        raise ValueError(f"unsupported method {method}")
    rows = _measured(candles, method, target_seconds, window).select("symbol", "ts", "x", "threshold")
    if chunk:
        folded = _chunked(rows, method == "imbalance", chunk)
    else:
        numbered = rows.withColumn("first", F.row_number().over(by_time()) == 1).sortWithinPartitions("symbol", "ts")
        folded = numbered.mapInArrow(_folded(method == "imbalance"), schema_of(rows, "symbol", timestamp="long", bar_id="long", total="double", threshold="double"))
    if not keep_partial:  # the last bar goes if it is not full and has not come far enough
        last = F.max_by(F.struct("bar_id", "total", "threshold"), "timestamp").over(Window.partitionBy("symbol"))
        done = F.coalesce(F.try_divide("last.total", "last.threshold"), F.lit(0.0))
        short = (F.col("bar_id") == F.col("last.bar_id")) & (done < min(max(least, 0.0), 1.0))
        folded = folded.withColumn("last", last).where(~short)
    return folded.select("symbol", "timestamp", "bar_id")


def event_bars(candles: DataFrame, method: str = "dollar", **options) -> DataFrame:
    """(symbol, bar_id, ts, open .. volume) of dollar or imbalance bars; ts is the last candle's time."""
    rows = candles.join(event_mapping(candles, method, **options).withColumnRenamed("timestamp", "ts"), ["symbol", "ts"])
    return rows.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def chosen_bars(candles: DataFrame, target_seconds: int = 14_400, tolerance: float = 0.25, window: int = 60) -> DataFrame:
    """The bars of the method whose median gap is nearest the target, with column method; event bars win within the tolerance."""
    columns = ["symbol", "bar_id", "ts", "open", "high", "low", "close", "volume"]
    kinds = {"time": time_bars(candles, target_seconds), **{m: event_bars(candles, m, target_seconds=target_seconds, window=window) for m in ("dollar", "imbalance")}}
    every = None
    for method, bars in kinds.items():
        bars = bars.select(*columns, F.lit(method).alias("method"))
        every = bars if every is None else every.unionByName(bars)
    # Every bar is made once: medians, scores and the choice are windows over the same rows.
    rows = every.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("symbol", "method").orderBy("ts")))
    rows = rows.withColumn("off", F.coalesce(F.abs(F.percentile("gap", 0.5).over(Window.partitionBy("symbol", "method")) / 1e6 - target_seconds), F.lit(float("inf"))))
    event = (F.col("method") != "time") & (F.col("off") <= tolerance * target_seconds)
    order = F.struct(F.when(event, 0).otherwise(1).alias("a"), F.col("off"), F.when(event, F.col("method")).alias("b"), F.array_position(F.lit(["time", "dollar", "imbalance"]), F.col("method")).alias("c"), F.col("method"))
    rows = rows.withColumn("best", F.min(order).over(Window.partitionBy("symbol"))["method"])
    return rows.where("method = best").select("symbol", "method", *columns[1:])
