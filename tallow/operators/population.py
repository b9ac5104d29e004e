"""Many rules at once: their signals as one array column, their evaluation by (symbol, rule).

A symbol's rows are sorted once, whatever the number of rules: positions and
turnovers are arrays beside each other, and what a rule needs of its own are
sums, made where the rows are and summed by symbol, rule and fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, ratio
from ..functions.rules import compiled
from ..sources.tables import settled
from . import strategy
from .evaluation import YEAR_S, Fees, blocks, folds


def _by_rule(rows: DataFrame, value: str, result: Column) -> DataFrame:
    """(symbol, of): for each symbol the array of result over the rules' elements of the array value."""
    each = rows.select("symbol", F.posexplode(value).alias("rule", "x")).groupBy("symbol", "rule").agg(result.alias("r"))
    return each.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "r"))), lambda s: s["r"]).alias("of"))  # an element for each rule


def values(features: DataFrame, expressions: list[str], names: Iterable[str] | None = None) -> DataFrame:
    """features' symbol and ts with raw, an array with each rule's value, in the order of the rules."""
    names = [c for c in features.columns if c not in ("symbol", "ts")] if names is None else list(names)
    return features.select("symbol", "ts", F.array(*[compiled(e, names) for e in expressions]).alias("raw"))


def bounded(rows: DataFrame) -> DataFrame:
    """rows of values with signals in place of raw: bounded as rules.with_signal does, by each rule's deviation within the symbol."""
    usable = lambda s: s.isNotNull() & ~F.isnan(s) & (s < float("inf")) & (s > 1e-6)
    spread = _by_rule(rows, "raw", F.stddev_pop("x"))
    signal = F.zip_with("raw", "of", lambda x, s: F.tanh(x / F.when(usable(s), s).otherwise(1.0)))
    return rows.join(spread, "symbol").withColumn("signals", signal).drop("raw", "of")


def traded(rows: DataFrame, threshold: float = 0.1, fees: Fees = Fees()) -> DataFrame:
    """rows (symbol, ts, signals, ret) with trades, an array with each rule's turnover, entry, gross, cost and net."""
    number = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    position = F.transform("signals", lambda s: F.when(F.abs(number(s)) > threshold, F.signum(number(s))).otherwise(0.0))
    df = rows.select("symbol", "ts", number(F.col("ret")).alias("ret"), position.alias("now")).withColumn("before", F.lag("now").over(by_time()))
    turn = F.zip_with("now", F.coalesce("before", "now"), lambda a, b: F.abs(a - b))
    entry = F.zip_with("now", F.coalesce("before", F.transform("now", lambda _: F.lit(0.0))), lambda a, b: (a != 0) & (b == 0))
    df = df.select("symbol", "ts", "ret", "now", turn.alias("turn"), entry.alias("entry"))
    part = _by_rule(df, "turn", F.least(F.greatest(F.avg("x"), F.lit(0.0)), F.lit(1.0)))
    df = df.join(part, "symbol")

    def trade(x: Column, part: Column) -> Column:
        cost = x["turn"] * fees.cost(F.lit(False), part) / 10_000
        gross = x["now"] * F.col("ret")
        return F.struct(x["turn"].alias("turn"), x["entry"].alias("entry"), gross.alias("gross"), cost.alias("cost"), (gross - cost).alias("net"), part.alias("part"))

    return df.select("symbol", "ts", F.zip_with(F.arrays_zip("now", "turn", "entry"), "of", trade).alias("trades"))


def evaluated(rows: DataFrame, expressions: list[str], splits: int = 6, threshold: float = 0.1, min_trades: int = 10, trials: int | None = None, fees: Fees = Fees(), test_blocks: int = 1) -> DataFrame:
    """(symbol, rule, expression, metrics ..): for each rule of rows (symbol, ts, signals, ret) what strategy.evaluated gives for it alone."""
    rows = traded(rows, threshold, fees)
    rows = blocks(rows, splits)
    each = rows.select("symbol", F.posexplode("trades").alias("rule", "x")).select("symbol", "rule", "x.*")
    share = ((F.col("n") - 1) / F.col("n")).cast("double")  # moments are over n, deviations over n - 1
    m = each.groupBy("symbol", "rule").agg(
        F.count("*").alias("n"), F.avg("net").alias("mean_return"), F.stddev_samp("net").alias("sd"), F.stddev_pop("net").alias("std_return"), F.skewness("net").alias("s3"), F.kurtosis("net").alias("s4"),
        F.avg("gross").alias("mean_gross_return"), F.avg("cost").alias("mean_cost"), F.max("part").alias("mean_participation"), F.avg("turn").alias("turnover"), F.avg((F.col("net") > 0).cast("double")).alias("breadth"), F.count_if("entry").alias("trade_count"),
    )
    moved = F.col("sd") > 0
    m = m.withColumns({"skew": F.when(moved, F.col("s3") * share**1.5), "kurt": F.when(moved, (F.col("s4") + 3) * share**2), "sharpe_total": ratio(F.col("mean_return"), F.when(moved, F.col("sd")))})
    m = m.withColumns({"skew": F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)), "kurt": F.coalesce(F.nanvl("kurt", F.lit(3.0)), F.lit(3.0))}).drop("s3", "s4", "sd")
    by_fold = _fold_sharpes(rows, splits, test_blocks).groupBy("symbol", "rule").agg(F.avg("sharpe").alias("sharpe_mean"), F.count("*").alias("folds"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("pbo"))
    m = m.join(by_fold, ["symbol", "rule"])
    sharpe, n, skew, kurt, enough = F.col("sharpe_total"), F.col("n"), F.col("skew"), F.col("kurt"), F.col("trade_count") >= min_trades
    count = F.col("folds").cast("int") if trials is None else max(trials, 1)
    m = m.withColumns({"psr_z": strategy.psr_z(sharpe, n, skew, kurt), "dsr_z": F.when(enough, strategy.dsr_z(sharpe, n, count, skew, kurt, math.comb(splits, test_blocks))), "pbo": F.when(enough, F.col("pbo"))})
    m = m.withColumns({"psr": strategy.normal_cdf("psr_z"), "dsr": strategy.normal_cdf("dsr_z"), "expression": F.get(F.array(*map(F.lit, expressions)), F.col("rule"))})
    return m.select("symbol", "rule", "expression", "n", "mean_return", "std_return", "mean_gross_return", "mean_cost", "mean_participation", "turnover", "breadth", "trade_count", "sharpe_mean", "sharpe_total", "skew", "kurt", "psr_z", "psr", "dsr_z", "dsr", "pbo")


def _fold_sharpes(rows: DataFrame, splits: int, test_blocks: int) -> DataFrame:
    """(symbol, rule, fold, sharpe) of rows (symbol, ts, block, trades): annualised by the fold's median gap, which rules share."""
    times = folds(rows.select("symbol", "ts"), splits, test_blocks)
    tested = times.withColumn("gap", (F.col("ts") - F.lag("ts").over(Window.partitionBy("symbol", "fold").orderBy("ts"))) / 1e6).groupBy("symbol", "fold").agg(F.percentile("gap", 0.5).alias("gap"))
    if test_blocks == 1:  # a fold is a block
        each = rows.select("symbol", F.col("block").alias("fold"), F.posexplode("trades").alias("rule", "x"))
    else:
        each = times.join(rows.select("symbol", "ts", "trades"), ["symbol", "ts"]).select("symbol", "fold", F.posexplode("trades").alias("rule", "x"))
    g = each.groupBy("symbol", "rule", "fold").agg(F.avg("x.net").alias("m"), F.stddev_pop("x.net").alias("s")).join(tested, ["symbol", "fold"])
    flat = (F.col("s") <= 1e-12 * F.greatest(F.abs("m"), F.lit(1e-12))) | F.col("gap").isNull()
    return g.select("symbol", "rule", "fold", F.when(flat, 0.0).otherwise(F.try_divide("m", "s") * F.sqrt(YEAR_S / F.greatest("gap", F.lit(1.0)))).alias("sharpe"))


def unpriced(rows: DataFrame, expressions: list[str]) -> DataFrame:
    """(symbol, rule, expression, sharpe, mean_return, std_return, turnover, breadth, fitness) of rows (symbol, ts, signals, ret) without costs, positions or folds: signals times returns.

    fitness is the Sharpe ratio, minus infinity where a rule's signal or its gains do not vary.
    """
    df = rows.withColumn("before", F.lag("signals").over(by_time()))
    moves = F.zip_with("signals", F.coalesce("before", F.transform("signals", lambda _: F.lit(None).cast("double"))), lambda a, b: F.struct(a.alias("s"), F.abs(a - b).alias("turn")))
    each = df.select("symbol", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.posexplode(moves).alias("rule", "x"))
    gain = F.col("x.s") * F.col("ret")
    m = each.groupBy("symbol", "rule").agg(F.avg(gain).alias("mean_return"), F.stddev_pop(gain).alias("std_return"), F.stddev_pop("x.s").alias("spread"), F.avg("x.turn").alias("turnover"), F.avg((gain > 0).cast("double")).alias("breadth"))
    sharpe = F.when((F.col("spread") > 0) & (F.col("std_return") > 0), F.col("mean_return") / F.col("std_return"))
    m = m.withColumns({"sharpe": sharpe, "fitness": F.coalesce(sharpe, F.lit(float("-inf"))), "expression": F.get(F.array(*map(F.lit, expressions)), F.col("rule"))})
    return m.select("symbol", "rule", "expression", "sharpe", "mean_return", "std_return", "turnover", "breadth", "fitness")


def assessed(features: DataFrame, returns: DataFrame, expressions: list[str], turnover_weight: float = 1.0, breadth_weight: float = 1.0, names: Iterable[str] | None = None, evaluator: Callable[..., DataFrame] = evaluated, **options) -> DataFrame:
    """The evaluator's row for each symbol and rule over features, with fitness, where features and returns (symbol, ts, ret) meet.

    evaluator: of (rows, expressions, options) with rows (symbol, ts, signals,
    ret); its own fitness stands, else it is taken from its metrics. The rules'
    values are computed once and kept.
    """
    rows = settled(values(features, expressions, names).join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"]))
    scored = evaluator(bounded(rows), expressions, **options)
    return scored if "fitness" in scored.columns else strategy.fitness(scored, turnover_weight, breadth_weight)


def ranked(scored: DataFrame) -> DataFrame:
    """scored rules (symbol, rule, fitness ..) with place, 1 for a symbol's best: what one step of a search selects from. Of equals the earlier rule comes first."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("fitness"), "rule")))
