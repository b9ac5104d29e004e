"""Triple-barrier labels and their diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, last_rows, ratio, schema_of

HOUR_US = 3_600_000_000


#: So many spans before a row its exponential weight is under 1e-34: what lies further back does not reach a double.
_SPANS = 40


def _ewm(span: int):
    """For one chunk of a series with the rows before it: the exponentially weighted deviation up to each row, corrected for bias, of rows that are the chunk's own."""
    a = 2 / (span + 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__n")
        x, n = table["__ret"].to_pylist(), table["__n"].to_numpy()
        mean, cov = x[0], 0.0
        vol = np.zeros(len(x))
        for k in range(1, len(x)):
            old, mean = mean, (1 - a) * mean + a * x[k]
            cov = (1 - a) * (cov + (old - mean) ** 2) + a * (x[k] - mean) ** 2
            vol[k] = cov
        decay = (1 - a) ** 2
        squares = decay**n + a * a * (1 - decay**n) / (1 - decay)  # of the weights of the n + 1 rows so far
        vol = np.sqrt(vol / np.where(n > 0, 1 - squares, 1.0))
        own = table.append_column("__vol", pa.array(np.where(n > 0, vol, np.nan)))
        return own.filter(own["__own"])

    return run


def volatility(bars: DataFrame, lookback: int = 48, chunk: int = 50_000) -> DataFrame:
    """bars with sigma: exponentially weighted deviation of returns; where that is null or not positive, the rolling mean of their sizes.

    A series is cut into chunks of so many rows; each is a task's work, with the
    rows before it that still have weight.
    """
    halo, w = _SPANS * lookback, by_time()
    df = bars.withColumn("__ret", F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    df = df.withColumn("__mean", F.avg(F.abs("__ret")).over(last_rows(lookback))).withColumn("__n", (F.row_number().over(w) - 1).cast("long"))
    own = F.floor(F.col("__n") / chunk)
    parts = F.sequence(own, F.floor((F.col("__n") + halo) / chunk))  # its own, and those that it is shortly before
    df = df.withColumn("__chunk", F.explode(parts)).withColumn("__own", F.col("__chunk") == own)
    df = df.groupBy("symbol", "__chunk").applyInArrow(_ewm(lookback), schema_of(df, __vol="double"))
    known = (F.col("__vol") > 0) & ~F.isnan("__vol")
    return df.withColumn("sigma", F.when(known, F.col("__vol")).otherwise(F.col("__mean"))).drop("__vol", "__mean", "__ret", "__n", "__chunk", "__own")


def first_at(low: np.ndarray, high: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row k the first place from begin[k] on, before end[k], where x is not between low[k] and high[k]; else end[k].

    Extremes of blocks of 1, 2, 4, .. places are kept, and each row strides over
    the largest blocks that stay between its bounds: its work is the logarithm of
    the places.
    """
    tops, bottoms = [np.where(np.isnan(x), -np.inf, x)], [np.where(np.isnan(x), np.inf, x)]
    while 2 * (step := 1 << (len(tops) - 1)) <= len(x):
        tops.append(np.maximum(tops[-1][:-step], tops[-1][step:]))
        bottoms.append(np.minimum(bottoms[-1][:-step], bottoms[-1][step:]))
    at = begin.copy()
    for level in reversed(range(len(tops))):
        step = 1 << level
        fit = np.flatnonzero(at + step <= end)
        free = fit[(tops[level][at[fit]] < high[fit]) & (bottoms[level][at[fit]] > low[fit])]
        at[free] += step
    return at


def _passages(least: int, most: int):
    """For the bars of a span of time and of the horizon after it: the first of the later bars that meets a barrier, of the span's own bars."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        ts, close = table["ts"].to_numpy(), table["close"].to_numpy()
        begin = np.maximum(np.searchsorted(ts, ts + least), np.searchsorted(ts, ts, "right"))
        end = np.searchsorted(ts, ts + most, "right")
        low, high = table["dn_bar"].to_numpy(), table["up_bar"].to_numpy()
        at = first_at(np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high), close, begin, end)
        found = pa.array(at < end)
        at = pa.array(np.minimum(at, len(ts) - 1))
        hit = {f"__hit_{c}": pc.if_else(found, table[c].combine_chunks().take(at), None) for c in ("ts", "close", "bar_id")}
        for name, values in hit.items():
            table = table.append_column(name, values)
        return table.filter(table["__own"])

    return run


def triple_barrier(bars: DataFrame, sigma: str = "sigma", up: float = 2.0, down: float = 2.0, min_hours: float = 2.0, max_hours: float = 12.0, spans: int = 16) -> DataFrame:
    """bars (symbol, bar_id, ts, close, sigma) with y, hit, t1, exit_bar_id, exit_price, holding_hours, realized_return.

    Bars within the horizon, and the first at or after its end, are held against
    both barriers on their closes; the upper one comes first, then the lower,
    then time. Bars before min_hours do not count, unless one is the last. The
    bar at the horizon's end is found by one sort of bars and ends together; the
    first to meet a barrier by block extremes over the bars of so many horizons
    and the next, a task's work.
    """
    least, most, c = int(min_hours * HOUR_US), int(max_hours * HOUR_US), F.col
    point = F.struct("ts", "close", "bar_id")
    width = F.greatest(c(sigma), F.lit(1e-6))
    df = bars.select("symbol", c("ts").cast("long").alias("ts"), c("close").cast("double").alias("close"), "bar_id", (c("close") * (1 + up * width)).alias("up_bar"), (c("close") * (1 - down * width)).alias("dn_bar"))
    span = max(spans * most, 1)
    own = F.floor(c("ts") / span)
    df = df.withColumn("__span", F.explode(F.sequence(F.floor((c("ts") - most) / span), own))).withColumn("__own", c("__span") == own)
    schema = schema_of(df, __hit_ts="long", __hit_close="double", __hit_bar_id=df.schema["bar_id"].dataType)
    df = df.groupBy("symbol", "__span").applyInArrow(_passages(least, most), schema).drop("__span", "__own")
    df = df.withColumn("within", F.when(c("__hit_ts").isNotNull(), F.struct(*[c(f"__hit_{k}").alias(k) for k in ("ts", "close", "bar_id")]))).drop("__hit_ts", "__hit_close", "__hit_bar_id")
    ends = df.select("*", (c("ts") + most).alias("at"), F.lit(0).alias("is_bar"), F.lit(None).cast(df.select(point.alias("p")).schema["p"].dataType).alias("point"))
    points = df.select("symbol", c("ts").alias("at"), F.lit(1).alias("is_bar"), point.alias("point"))
    after = Window.partitionBy("symbol").orderBy(F.desc("at"), F.desc("is_bar")).rowsBetween(Window.unboundedPreceding, 0)
    df = ends.unionByName(points, allowMissingColumns=True).withColumn("next", F.last("point", ignorenulls=True).over(after)).where("is_bar = 0").drop("at", "is_bar", "point")
    df = df.withColumn("end", F.max(point).over(Window.partitionBy("symbol"))).withColumn("next", F.coalesce("next", "end"))
    meets = ((c("next.ts") - c("ts") >= least) | (c("next.bar_id") == c("end.bar_id"))) & ((c("next.close") >= c("up_bar")) | (c("next.close") <= c("dn_bar")))
    df = df.withColumn("first_hit", F.coalesce("within", F.when(meets, c("next")))).withColumn("expiry", F.least(c("ts") + most, c("end.ts")))
    df = df.withColumn("exit", F.coalesce("first_hit", "next"))
    hit = F.when(c("first_hit").isNull(), "time").when(c("first_hit.close") >= c("up_bar"), "up").otherwise("down")
    df = df.withColumns({"hit": hit, "t1": F.coalesce("first_hit.ts", "expiry")})
    df = df.withColumns({
        "y": F.when(c("hit") == "up", 1).when(c("hit") == "down", -1).otherwise(0), "exit_bar_id": c("exit.bar_id"), "exit_price": c("exit.close"),
        "holding_hours": (c("exit.ts") - c("ts")) / float(HOUR_US), "realized_return": F.coalesce(ratio(c("exit.close"), c("close")) - 1, F.lit(0.0)),
    })
    return df.select("symbol", "bar_id", "ts", "t1", "y", "up_bar", "dn_bar", "hit", "holding_hours", "exit_price", "exit_bar_id", "realized_return")


def distribution(labels: DataFrame) -> DataFrame:
    """(y, share) of all labels."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row for each class
    return labels.groupBy("y").agg(F.count("*").alias("n")).select("y", (F.col("n") / total).alias("share"))


def diagnostics(labels: DataFrame) -> DataFrame:
    """(symbol, rows, the shares of y = 1, 0, -1 and of hits up, down, time, avg_holding_hours)."""
    share = lambda condition: F.avg(condition.cast("double"))
    classes = [share(F.col("y") == v).alias(f"class_{k}") for k, v in (("up", 1), ("flat", 0), ("down", -1))]
    hits = [share(F.col("hit") == h).alias(f"hit_{h}") for h in ("up", "down", "time")]
    return labels.groupBy("symbol").agg(F.count("*").alias("rows"), *classes, *hits, F.avg("holding_hours").alias("avg_holding_hours"))


def require_balance(labels: DataFrame, least: float = 0.05) -> None:
    small = [r["y"] for r in distribution(labels).collect() if r["share"] < least]
    if small:
        raise ValueError(f"label classes {sorted(small)} hold less than {least} of the rows")
