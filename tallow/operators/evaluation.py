"""Costs, cross-validation by time blocks, and strategy metrics."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, by_time, ratio

YEAR_S = 31_557_600.0


@dataclass(frozen=True)
class Fees:
    """Costs in basis points; impact is for each percent of participation."""

    maker: float = 1.0
    taker: float = 4.0
    half_spread: float = 1.5
    impact: float = 0.5

    def cost(self, maker: Column, participation: Column) -> Column:
        fixed = F.when(maker, self.maker).otherwise(self.taker + 2 * self.half_spread)
        return fixed + F.greatest(participation, F.lit(0.0)) * self.impact


def executed(orders: DataFrame, fees: Fees = Fees(), queue_bps: float = 1.0, impact_bps: float = 0.1, key: str = "symbol") -> DataFrame:
    """orders (key, side, price, quantity, and maker, participation if there) with fill_price, fee_bps, fee_paid, slippage_bps; sizes count against the key's largest."""
    for name, default in (("maker", F.lit(False)), ("participation", F.lit(0.0))):
        if name not in orders.columns:
            orders = orders.withColumn(name, default)
    largest = orders.groupBy(key).agg(F.max(F.abs("quantity")).alias("largest"))
    small = largest.limit(100_001).count() <= 100_000
    df = orders.join(F.broadcast(largest) if small else largest, key)  # orders stay where they are unless keys are very many
    sign = F.when(F.col("side") == "buy", 1.0).when(F.col("side") == "sell", -1.0)
    size = F.coalesce(ratio(F.abs("quantity"), F.col("largest")), F.lit(0.0))
    df = df.withColumn("fill_price", F.col("price") * (1 + sign * (queue_bps / 10_000) + sign * size * (impact_bps / 10_000)))
    df = df.withColumn("fee_bps", fees.cost(F.col("maker"), F.col("participation").cast("double")))
    paid = F.abs("quantity") * F.col("fill_price") * F.col("fee_bps") / 10_000
    return df.withColumn("fee_paid", paid).withColumn("slippage_bps", ratio(F.col("fill_price") - F.col("price"), F.col("price")) * 10_000).drop("largest")


def blocks(rows: DataFrame, splits: int) -> DataFrame:
    """rows with block, 0 to splits - 1: consecutive rows of a symbol, in sizes that differ by one at most."""
    return rows.withColumn("block", F.ntile(splits).over(by_time()) - 1)


def folds(rows: DataFrame, splits: int = 6, test_blocks: int = 1) -> DataFrame:
    """(symbol, ts, .., fold): a row for each fold that tests it; folds are all choices of test_blocks blocks."""
    spark = rows.sparkSession
    chosen = [(b, k) for k, c in enumerate(combinations(range(splits), test_blocks)) for b in c]
    return blocks(rows, splits).join(F.broadcast(spark.createDataFrame(chosen, "block int, fold int")), "block").drop("block")


def training(rows: DataFrame, splits: int = 6, embargo_minutes: float = 60, test_blocks: int = 1) -> DataFrame:
    """(symbol, ts, fold) of the rows that each fold may learn from: in no test block and not within the embargo of one."""
    gap = int(embargo_minutes * 60_000_000)
    spans = blocks(rows, splits).groupBy("symbol", "block").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    chosen = [(b, k) for k, c in enumerate(combinations(range(splits), test_blocks)) for b in c]
    spans = spans.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, "block int, fold int")), "block")
    tests = spans.groupBy("symbol", "fold").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # test_blocks spans for each symbol and fold
    near = F.exists("spans", lambda s: (F.col("ts") >= s["lo"] - gap) & (F.col("ts") <= s["hi"] + gap))
    return rows.select("symbol", "ts").join(tests, "symbol").where(~near).select("symbol", "ts", "fold")


def event_training(events: DataFrame, splits: int = 6, embargo_minutes: float = 60) -> DataFrame:
    """(symbol, ts, fold) of events (symbol, ts, t1) that a fold may learn from: their span meets neither the test block's span nor the embargo around it."""
    gap = int(embargo_minutes * 60_000_000)
    spans = blocks(events, splits).groupBy("symbol", F.col("block").alias("fold")).agg(F.min("ts").alias("lo"), F.max("t1").alias("hi"))
    rows = blocks(events, splits).select("symbol", "ts", "t1", "block").join(spans, "symbol").where("block <> fold")
    overlaps = (F.col("ts") <= F.col("hi")) & (F.col("t1") >= F.col("lo"))
    embargoed = (F.col("ts") >= F.col("lo") - gap) & (F.col("ts") <= F.col("hi") + gap)
    return rows.where(~overlaps & ~embargoed).select("symbol", "ts", "fold")


def fold_sharpe(rows: DataFrame, value: str = "ret") -> DataFrame:
    """(symbol, fold, sharpe, abs_return_mean, pnl) of rows (symbol, ts, fold, value): annualised by the median gap, 0 where nothing varies."""
    rows = rows.withColumn("gap", (F.col("ts") - F.lag("ts").over(Window.partitionBy("symbol", "fold").orderBy("ts"))) / 1e6)
    g = rows.groupBy("symbol", "fold").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.percentile("gap", 0.5).alias("gap"), F.avg(F.abs(value)).alias("abs_return_mean"), F.sum(value).alias("pnl"))
    flat = (F.col("s") <= 1e-12 * F.greatest(F.abs("m"), F.lit(1e-12))) | F.col("gap").isNull()
    sharpe = F.when(flat, 0.0).otherwise(F.try_divide("m", "s") * F.sqrt(YEAR_S / F.greatest("gap", F.lit(1.0))))
    return g.select("symbol", "fold", sharpe.alias("sharpe"), "abs_return_mean", "pnl")


def overfit_share(sharpes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(symbol, pbo): the share of folds at or below the threshold."""
    return sharpes.groupBy("symbol").agg(F.avg((F.col("sharpe") <= threshold).cast("double")).alias("pbo"))


def changes(series: DataFrame, value: str, step: int = DAY_US) -> DataFrame:
    """series (ts, value) with before, the value of the row before in time. Each span of step is a task's work; spans hand on their last value."""
    rows = series.withColumn("span", F.floor(F.col("ts") / step))
    last = rows.groupBy("span").agg(F.max_by(value, "ts").alias("last"))
    last = last.select("span", F.lag("last").over(Window.orderBy("span")).alias("handed"))  # a row for each span of time
    inside = F.lag(value).over(Window.partitionBy("span").orderBy("ts"))
    return rows.withColumn("inside", inside).join(last, "span").withColumn("before", F.coalesce("inside", "handed")).drop("span", "inside", "handed")


def ensemble(signals: DataFrame, cap: float = 0.5, fees: Fees = Fees()) -> DataFrame:
    """(ts, ensemble_score, turnover, fee_adjusted_score, weight_sum) of signals (panel, ts, score): inverse-deviation weights; times that a panel lacks count as 0."""
    weights = signals.groupBy("panel").agg(F.coalesce(F.try_divide(F.lit(1.0), F.stddev_pop("score")), F.lit(0.0)).alias("w"))
    s = weights.agg(F.sum("w").alias("total"), F.count("*").alias("k")).first()  # panels are few
    if not s["k"]:
        raise ValueError("no signal panels")
    weights = F.broadcast(weights) if s["k"] <= 100_000 else weights
    both = signals.join(weights, "panel").groupBy("ts").agg(F.sum(F.col("w") * F.col("score")).alias("x"), F.count("score").alias("k"))
    df = both.select("ts", F.when(F.col("k") == s["k"], F.col("x") / (s["total"] or 1.0)).otherwise(0.0).alias("ensemble_score"))
    df = changes(df, "ensemble_score")
    df = df.withColumn("turnover", F.least(F.coalesce(F.abs(F.col("ensemble_score") - F.col("before")), F.lit(0.0)), F.lit(cap))).drop("before")
    mean = df.agg(F.avg("turnover")).first()[0] or 0.0
    cost = fees.cost(F.lit(False), F.lit(mean)) / 10_000
    adjusted = F.col("ensemble_score") - F.signum("ensemble_score") * cost
    return df.select("ts", "ensemble_score", "turnover", adjusted.alias("fee_adjusted_score"), F.lit(1.0 if s["total"] else 0.0).alias("weight_sum"))


def meta_label(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    return signals.withColumn("meta", F.when(F.abs(F.coalesce("score", F.lit(0.0))) > threshold, 1).otherwise(0))
