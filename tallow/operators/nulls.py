"""What chance alone would give: random walks and permuted blocks, each run a key of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time
from ..sources.tables import settled
from .evaluation import YEAR_S, fold_sharpe, folds


def real_sharpe(returns: DataFrame, splits: int = 6) -> DataFrame:
    """(symbol, real_sharpe): the mean Sharpe ratio of the folds of returns (symbol, ts, ret)."""
    return fold_sharpe(folds(returns, splits)).groupBy("symbol").agg(F.avg("sharpe").alias("real_sharpe"))


def permuted(returns: DataFrame, runs: int = 100, block: int = 24, splits: int = 6, order: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(symbol, run, sharpe): mean fold Sharpe of returns whose blocks of so many rows are shuffled; times stay where they are.

    order: a column by which (run, block) are sorted. A run moves blocks' sums,
    not rows: a block within one fold adds its sums to it, one across an edge is
    looked up at the edge in its running sums. So work grows with runs times
    blocks and folds. Sums are of whole numbers, 2**40 for the largest difference
    from the symbol's first return, so that their order does not matter.
    """
    order = order or (lambda run, b: F.xxhash64(run, b))
    size, c = max(block, 1), F.col
    whole = returns.groupBy("symbol").agg(F.count("*").alias("n"), F.min_by("ret", "ts").alias("first"), F.min("ret").alias("least"), F.max("ret").alias("most"))  # a row for each symbol
    far = F.greatest(c("most") - c("first"), c("first") - c("least"))
    whole = whole.select("symbol", "n", "first", F.when(far > 0, F.pow(F.lit(2.0), 40 - F.ceil(F.log2(far)))).otherwise(1.0).alias("scale"))
    rows = returns.withColumn("place", (F.row_number().over(by_time()) - 1).cast("long")).join(whole, "symbol")
    rows = rows.select("symbol", F.floor(c("place") / size).alias("block"), (c("place") % size).alias("inside"), F.rint((c("ret") - c("first")) * c("scale")).cast("decimal(20,0)").alias("d"))
    w = Window.partitionBy("symbol", "block").orderBy("inside").rowsBetween(Window.unboundedPreceding, 0)
    rows = settled(rows.select("symbol", "block", (c("inside") + 1).alias("upto"), F.sum("d").over(w).cast("decimal(38,0)").alias("s1"), F.sum((c("d") * c("d")).cast("decimal(38,0)")).over(w).alias("s2")))
    blocks = rows.groupBy("symbol", "block").agg(F.max("upto").alias("size"), F.max_by("s1", "upto").alias("s1"), F.max_by("s2", "upto").alias("s2"))
    blocks = blocks.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    before = Window.partitionBy("symbol", "run").orderBy(order(c("run"), c("block")), "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("offset", F.sum("size").over(before) - c("size")).join(whole, "symbol")
    base, extra = F.floor(c("n") / splits), c("n") % splits  # the first folds have a row more
    edge = lambda f: f * base + F.least(f, extra)
    fold = lambda at: F.when(at < extra * (base + 1), F.floor(at / (base + 1))).otherwise(extra + F.floor((at - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    blocks = blocks.withColumns({"low": fold(c("offset")), "high": fold(c("offset") + c("size") - 1)})
    inside = blocks.where("low = high").select("symbol", "run", c("low").alias("fold"), c("size").alias("k"), "s1", "s2")
    cut = blocks.where("low < high").withColumn("fold", F.explode(F.sequence("low", "high")))
    ends = F.array(F.struct(F.lit(-1).alias("sign"), (edge(c("fold")) - c("offset")).alias("upto")), F.struct(F.lit(1).alias("sign"), F.least(edge(c("fold") + 1) - c("offset"), c("size")).alias("upto")))
    cut = cut.select("symbol", "run", "block", "fold", F.explode(ends).alias("e")).select("symbol", "run", "block", "fold", "e.*").where("upto > 0")
    cut = cut.join(rows, ["symbol", "block", "upto"]).select("symbol", "run", "fold", (c("sign") * c("upto")).alias("k"), *[F.when(c("sign") > 0, c(x)).otherwise(-c(x)).alias(x) for x in ("s1", "s2")])
    stats = inside.unionByName(cut).groupBy("symbol", "run", "fold").agg(F.sum("k").alias("k"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).join(whole, "symbol")
    mean, square = c("s1").cast("double") / c("k"), c("s2").cast("double") / c("k")
    stats = stats.select("symbol", "run", c("fold").cast("int").alias("fold"), (c("first") + mean / c("scale")).alias("m"), (F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / c("scale")).alias("s"))
    timed = folds(returns, splits).withColumn("gap", (c("ts") - F.lag("ts").over(Window.partitionBy("symbol", "fold").orderBy("ts"))) / 1e6)
    gaps = timed.groupBy("symbol", "fold").agg(F.percentile("gap", 0.5).alias("gap"))  # a row for each symbol and fold
    flat = (c("s") <= 1e-12 * F.greatest(F.abs("m"), F.lit(1e-12))) | c("gap").isNull()
    sharpe = F.when(flat, 0.0).otherwise(F.try_divide("m", "s") * F.sqrt(YEAR_S / F.greatest("gap", F.lit(1.0))))
    each = stats.join(gaps, ["symbol", "fold"]).groupBy("symbol", "run").agg(F.array_sort(F.collect_list(sharpe)).alias("x"))  # as many as folds
    return each.select("symbol", "run", (F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x")).alias("sharpe"))


def walk_returns(n: int, rng: np.random.Generator) -> np.ndarray:
    """Returns of a random walk of minutes: normal, deviation 0.01, in logarithms."""
    return np.expm1(rng.normal(0.0, 0.01, n))


def _walked(splits: int, seed: int, generator: Callable[[int, np.random.Generator], np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in batches:
            out = []
            for run, n, key in zip(jobs["run"], jobs["n"], jobs["key"], strict=True):
                x = generator(int(n), np.random.default_rng([seed, int(run), int(key)]))
                parts = [p for p in np.array_split(x, splits) if len(p)]
                sharpes = [p.mean() / p.std() * np.sqrt(YEAR_S / 60.0) if len(p) > 1 and p.std() > 0 else 0.0 for p in parts]
                out.append(float(np.mean(sharpes)) if sharpes else 0.0)
            yield pd.DataFrame({"symbol": jobs["symbol"], "run": jobs["run"], "sharpe": out})

    return run


def random_walks(returns: DataFrame, runs: int = 100, splits: int = 6, seed: int = 0, generator: Callable[[int, np.random.Generator], np.ndarray] = walk_returns) -> DataFrame:
    """(symbol, run, sharpe): mean fold Sharpe of random series of each symbol's length; a run is one row of work."""
    jobs = returns.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("key", F.crc32(F.col("symbol").cast("binary")))
    jobs = jobs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    return jobs.repartition("symbol", "run").mapInPandas(_walked(splits, seed, generator), "symbol string, run long, sharpe double")


def p_values(real: DataFrame, null: DataFrame) -> DataFrame:
    """(symbol, real_sharpe, null_mean, p_value, runs): how often chance does as well, each with one more than seen."""
    both = null.join(real, "symbol").groupBy("symbol", "real_sharpe").agg(F.avg("sharpe").alias("null_mean"), F.count_if(F.col("sharpe") >= F.col("real_sharpe")).alias("k"), F.count("*").alias("runs"))
    return both.select("symbol", "real_sharpe", "null_mean", ((F.col("k") + 1) / (F.col("runs") + 1)).alias("p_value"), "runs")


def summary(returns: DataFrame, runs: int = 100, block: int = 24, splits: int = 6, seed: int = 0) -> DataFrame:
    """(symbol, real_sharpe, random_null_mean, random_p, perm_null_mean, perm_p, runs, block_size)."""
    real = real_sharpe(returns, splits)
    walks = p_values(real, random_walks(returns, runs, splits, seed)).select("symbol", "real_sharpe", F.col("null_mean").alias("random_null_mean"), F.col("p_value").alias("random_p"))
    perm = p_values(real, permuted(returns, runs, block, splits)).select("symbol", F.col("null_mean").alias("perm_null_mean"), F.col("p_value").alias("perm_p"))
    return walks.join(perm, "symbol").select("*", F.lit(runs).alias("runs"), F.lit(block).alias("block_size"))
