"""Strategy evaluation: positions, costs, moments, Sharpe ratios by fold, and their corrections for chance and for many trials."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, ratio
from .evaluation import Fees, fold_sharpe, folds, overfit_share


#: 1 / (1 * 3 * 5 ..), the largest first: coefficients of the normal distribution's series, for sizes up to _FAR.
_FAR = 8.3
_SERIES = np.cumprod(1.0 / np.arange(1, 2 * 140, 2))[::-1]


def normal_cdf(z: Column | str) -> Column:
    """The normal distribution by its series of positive terms; beyond 8.3 deviations it is 0 or 1 to a double's last digits."""
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    series = F.aggregate(F.lit(_SERIES), F.lit(0.0), lambda s, c: s * z * z + c)
    return F.when(z > _FAR, 1.0).when(z < -_FAR, 0.0).otherwise(0.5 + z * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series)


def _variability(sharpe: Column, skew: Column, kurt: Column) -> Column:
    v = 1 - skew * sharpe + (kurt - 3) / 4 * sharpe**2
    return F.when(v > 0, v)


def psr_z(sharpe: Column, n: Column, skew: Column, kurt: Column, reference: float = 0.0) -> Column:
    """The probabilistic Sharpe ratio before the normal distribution; null where it cannot be told."""
    return F.when(n > 1, (sharpe - reference) * F.sqrt(n - 1) / F.sqrt(_variability(sharpe, skew, kurt)))


def best_of(trials: int) -> float:
    """The normal quantile at which the best of so many trials is expected."""
    return NormalDist().inv_cdf(min(max(1 - 1 / trials, 1e-12), 1 - 1e-12)) if trials > 1 else 0.0


def dsr_z(sharpe: Column, n: Column, trials: Column | int, skew: Column, kurt: Column, most: int = 1, reference: float = 0.0) -> Column:
    """The deflated Sharpe ratio before the normal distribution. trials: a number, or a column of numbers from 1 to most."""
    best = F.lit(best_of(trials)) if isinstance(trials, int) else F.get(F.lit(np.array([best_of(t) for t in range(1, most + 1)])), F.greatest(trials, F.lit(1)) - 1)
    sigma = F.sqrt(_variability(sharpe, skew, kurt) / (n - 1))
    return F.when((n > 1) & (sigma > 0), (sharpe - (reference + sigma * best)) / sigma)


def aligned(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, ts, signal, ret) of the times that both have; nulls and nans count as 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return signals.join(returns, ["symbol", "ts"]).select("symbol", "ts", zero("signal"), zero("ret"))


def reindexed(signals: DataFrame, index: DataFrame) -> DataFrame:
    """A row for each (symbol, ts) of index, with the signal of that time or 0."""
    return index.select("symbol", "ts").join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))


def returns_of(labels: DataFrame) -> DataFrame:
    """labels as (symbol, ts, ret): realized returns, else gross ones, else directions, whichever column there is first."""
    for name in ("realized_return", "gross_return", "y", "ret"):
        if name in labels.columns:
            return labels.select("symbol", "ts", F.col(name).cast("double").alias("ret"))
    raise KeyError("labels hold no returns")


def net_returns(rows: DataFrame, threshold: float = 0.1, fees: Fees = Fees()) -> DataFrame:
    """rows (symbol, ts, signal, ret) with position, turnover, entry, gross, cost and net; one symbol's mean turnover is its participation."""
    position = F.when(F.abs("signal") > threshold, F.signum("signal")).otherwise(0.0)
    df = rows.withColumn("position", position).withColumn("before", F.lag("position").over(by_time()))
    df = df.withColumn("turnover", F.coalesce(F.abs(F.col("position") - F.col("before")), F.lit(0.0)))
    df = df.withColumn("entry", (F.col("position") != 0) & (F.coalesce("before", F.lit(0.0)) == 0)).drop("before")
    mean = df.groupBy("symbol").agg(F.least(F.greatest(F.avg("turnover"), F.lit(0.0)), F.lit(1.0)).alias("participation"))  # a row for each symbol
    df = df.join(mean, "symbol").withColumn("cost", F.col("turnover") * fees.cost(F.lit(False), F.col("participation")) / 10_000)
    df = df.withColumn("gross", F.col("position") * F.col("ret"))
    return df.withColumn("net", F.col("gross") - F.col("cost"))


def moments(rows: DataFrame, value: str = "net") -> DataFrame:
    """(symbol, n, mean, sd, sharpe_total, skew, kurt): deviation over n - 1, moments over n; without deviation skew 0, kurtosis 3 and no ratio."""
    first = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    d = F.col(value) - F.col("mean")
    third = rows.join(first, "symbol").groupBy("symbol").agg(F.avg(d**3).alias("m3"), F.avg(d**4).alias("m4"))
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    return first.join(third, "symbol").select("symbol", "n", "mean", "sd", ratio(F.col("mean"), sd).alias("sharpe_total"), F.coalesce(F.col("m3") / sd**3, F.lit(0.0)).alias("skew"), F.coalesce(F.col("m4") / sd**4, F.lit(3.0)).alias("kurt"))


def evaluated(signals: DataFrame, returns: DataFrame, splits: int = 6, threshold: float = 0.1, min_trades: int = 10, trials: int | None = None, fees: Fees = Fees(), test_blocks: int = 1) -> DataFrame:
    """A row of metrics for each symbol of signals (symbol, ts, signal) and returns (symbol, ts, ret).

    dsr and pbo are null under min_trades; trials are the folds unless given.
    """
    rows = net_returns(aligned(signals, returns), threshold, fees)
    sharpes = fold_sharpe(folds(rows, splits, test_blocks), "net")
    by_fold = sharpes.groupBy("symbol").agg(F.avg("sharpe").alias("sharpe_mean"), F.count("*").alias("folds")).join(overfit_share(sharpes), "symbol")
    means = rows.groupBy("symbol").agg(
        F.count_if("entry").alias("trade_count"), F.avg("turnover").alias("turnover"), F.avg((F.col("net") > 0).cast("double")).alias("breadth"), F.stddev_pop("net").alias("std_return"),
        F.avg("gross").alias("mean_gross_return"), F.avg("cost").alias("mean_cost"), F.max("participation").alias("mean_participation"),
    )
    m = moments(rows).join(means, "symbol").join(by_fold, "symbol")
    sharpe, n, skew, kurt, traded = F.col("sharpe_total"), F.col("n"), F.col("skew"), F.col("kurt"), F.col("trade_count") >= min_trades
    count = F.col("folds").cast("int") if trials is None else max(trials, 1)
    m = m.withColumn("psr_z", psr_z(sharpe, n, skew, kurt)).withColumn("dsr_z", F.when(traded, dsr_z(sharpe, n, count, skew, kurt, math.comb(splits, test_blocks))))
    m = m.withColumn("psr", normal_cdf("psr_z")).withColumn("dsr", normal_cdf("dsr_z")).withColumn("pbo", F.when(traded, F.col("pbo")))
    return m.select("symbol", "n", F.col("mean").alias("mean_return"), "std_return", "mean_gross_return", "mean_cost", "mean_participation", "turnover", "breadth", "trade_count", "sharpe_mean", "sharpe_total", "skew", "kurt", "psr_z", "psr", "dsr_z", "dsr", "pbo")


def fitness(metrics: DataFrame, turnover_weight: float = 0.1, breadth_weight: float = 0.1) -> DataFrame:
    """metrics with fitness: deflated ratio, less turnover, plus breadth, less overfit share; minus infinity where it cannot be told."""
    value = F.col("dsr") - turnover_weight * F.col("turnover") + breadth_weight * F.col("breadth") - F.col("pbo")
    return metrics.withColumn("fitness", F.coalesce(F.nanvl(value, F.lit(float("-inf"))), F.lit(float("-inf"))))


def guarded(real: DataFrame, synthetic: DataFrame, least_fit: float = 0.5, least_trades: int = 30, hits: int = 2, synthetic_fit: float = 0.3, share: float = 0.75, trade_ratio: float = 2.0) -> DataFrame:
    """real (symbol, fitness, trade_count) with synthetic_hits and leak: whether runs over random prices (symbol, run, fitness, trade_count) do nearly as well."""
    both = synthetic.select("symbol", F.col("fitness").alias("f"), F.col("trade_count").alias("t")).join(real, "symbol")
    alike = (F.col("f") >= synthetic_fit) & (F.col("f") >= share * F.col("fitness")) & (F.col("t") <= trade_ratio * F.col("trade_count"))
    counted = both.groupBy("symbol").agg(F.count_if(alike).alias("synthetic_hits"))
    out = real.join(counted, "symbol", "left").withColumn("synthetic_hits", F.coalesce("synthetic_hits", F.lit(0)))
    return out.withColumn("leak", (F.col("fitness") >= least_fit) & (F.col("trade_count") >= least_trades) & (F.col("synthetic_hits") >= hits))


def guard_summary(guarded_rows: DataFrame) -> DataFrame:
    """One row: symbols, flagged, passed, pending (no synthetic runs' fitness), the largest fitness and hits."""
    pending = F.col("fitness").isNull()
    return guarded_rows.agg(F.count("*").alias("symbols"), F.count_if("leak").alias("flagged"), F.count_if(~F.col("leak") & ~pending).alias("passed"), F.count_if(pending).alias("pending"), F.max("fitness").alias("max_fitness"), F.max("synthetic_hits").alias("max_hits"))
